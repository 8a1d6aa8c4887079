"""Geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, EARTH_KM = 6_371_000.0, 6373.0


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def wrap_positive(lon) -> Column:
    """Longitudes below zero moved up by a turn."""
    lon = col(lon)
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def wrap_signed(lon) -> Column:
    """Longitudes in [-180, 180]."""
    lon = col(lon)
    return F.when(lon > 180.0, lon - 360.0).when(lon < -180.0, lon + 360.0).otherwise(lon)


def crosses_dateline(lon_vertices) -> Column:
    """Whether vertices span less once longitudes are counted from 0 to 360, and span more than half a turn before."""
    v = col(lon_vertices)
    up = F.transform(v, wrap_positive)
    span, span360 = F.array_max(v) - F.array_min(v), F.array_max(up) - F.array_min(up)
    return (span360 < span) & (span > 180.0)


def expand_extremes(vertices, by: float, wrap: bool, pull_back: float = 0.0) -> Column:
    """Vertices with the first smallest moved down and the first largest moved up by ``by``.

    Longitudes (``wrap``) are rounded to 5 places half-even, +-180 takes the sign of the opposite extreme, and results wrap
    to [-180, 180]. A latitude that overshoots a pole is pulled back by ``pull_back``.
    """
    v = F.transform(col(vertices), lambda x: F.bround(x, 5))
    if wrap:
        low, high = F.array_min(v), F.array_max(v)
        v = F.transform(v, lambda x: F.when((x == 180.0) & (low < 0) & (F.abs(low) > F.abs(high - 360.0)), F.lit(-180.0)).when((x == -180.0) & (high > 0) & (high > 90.0), F.lit(180.0)).otherwise(x))
    at_high, at_low = F.array_position(v, F.array_max(v)) - 1, F.array_position(v, F.array_min(v)) - 1
    moved = F.transform(v, lambda x, i: x + F.when(i == at_high, F.lit(by)).otherwise(0.0) - F.when(i == at_low, F.lit(by)).otherwise(0.0))
    if wrap:
        return F.transform(moved, wrap_signed)
    return F.transform(moved, lambda x: F.when(x > 90.0, x - pull_back).when(x < -90.0, x + pull_back).otherwise(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def great_circle(lat1, lon1, lat2, lon2) -> Column:
    """Angle in radians between two points, the cosine clipped to [-1, 1]."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    c = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(F.radians(col(lon2)) - F.radians(col(lon1)))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def compass(value, axis: str, width: int) -> Column:
    """A bound as letter and digits: N15, W030; longitude 180 counts as west."""
    value = col(value)
    positive, negative = ("N", "S") if axis == "lat" else ("E", "W")
    letter = F.when(value < 0, negative)
    if axis == "lon":
        letter = letter.when(value == 180, "W")
    return F.concat(letter.otherwise(positive), F.lpad(F.abs(value).cast("int").cast("string"), width, "0"))


def tile_name(lat, lon) -> Column:
    """The file name of a 15-degree tile by its upper-left bounds."""
    return F.concat(F.lit("ETOPO_2022_v1_15s_"), compass(lat, "lat", 2), compass(lon, "lon", 3), F.lit("_surface.nc"))


def bounds_name(dataset, lat_max, lat_min, lon_min, lon_max) -> Column:
    """The file name of a 30-degree tile: the dataset, then its upper, left, lower and right bounds."""
    return F.concat(col(dataset), F.lit("_"), compass(lat_max, "lat", 2), F.lit("-"), compass(lat_min, "lat", 2), F.lit("_"), compass(lon_min, "lon", 3), F.lit("-"), compass(lon_max, "lon", 3), F.lit(".nc4"))


def in_polygon(x, y, vertices: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon; edges and vertices count as inside.

    Ray casting to the left: an edge flips the state when it straddles the point's height left of it. The edges are
    unrolled, so a triangle is one expression in generated code.
    """
    x, y = col(x), col(y)
    crossings, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        within = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
        edge = edge | ((cross == 0) & within)
        if y1 != y2:
            left = x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x
            crossings = crossings + ((F.lit(y1) > y) != (F.lit(y2) > y)).cast("int") * left.cast("int")
    return edge | (crossings % 2 == 1)


def in_polygon_columns(x: Column, y: Column, vx: Column, vy: Column) -> Column:
    """``in_polygon`` where each row has its own vertices, as two arrays."""
    n = F.size(vx)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(vx[k].alias("x1"), vy[k].alias("y1"), vx[(k + 1) % n].alias("x2"), vy[(k + 1) % n].alias("y2")))
    cross = lambda e: (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
    on = lambda e: (cross(e) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    flips = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) < x)
    return F.exists(edges, on) | (F.size(F.filter(edges, flips)) % 2 == 1)


def memory_gb(lat_deg) -> Column:
    """Working memory of one cell by latitude: flat to 60 degrees, growing to 85, then the cap."""
    a = F.abs(col(lat_deg))
    return F.when(a < 60, 10.0).when(a >= 85, 60.0).otherwise(10.0 * F.pow(1.0 / F.cos(F.radians(a)), 0.7))


def chunk_range(name) -> tuple[Column, Column]:
    """First and last cell id in a chunk's name."""
    n = col(name)
    return tuple(F.regexp_extract(n, r"(\d+)-(\d+)", k).cast("long") for k in (1, 2))


def rad2deg_columns(df, columns: list[str]):
    """Angles of the named columns (scalars or arrays) to degrees; other columns stay."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.transform(c, F.degrees) if kinds[c].startswith("array") else F.degrees(c) for c in columns})


TWO_PI = 2 * math.pi
