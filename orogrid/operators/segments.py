"""Segmentation: from a rectilinear raster and the vertices of cells to each cell's points on a metric lattice.

The steps are joins and aggregates over all cells at once: the box of every cell by nearest grid lines, an equi-join of boxes and
raster on blocks of indices, metres from each box's own corner, demeaning, a resample to equal spacing, a low-pass, a tapering mask
and the mask of the cell's polygon. Filters and tapers need a whole lattice and run as kernels by cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, in_polygon_columns
from ..session import saved
from . import lattices
from . import raster as R
from .joins import nearest

BLOCK = 64


def boxes(cells: DataFrame, raster: DataFrame, padding: int = 0) -> DataFrame:
    """(cell_id, lat_verts, lon_verts, i0, i1, j0, j1): from the grid line nearest each lower bound less ``padding`` up to, but not including, that nearest the upper plus ``padding``."""
    wanted = []
    for axis, verts, line in (("lat", "lat_verts", "i"), ("lon", "lon_verts", "j")):
        ends = cells.select("cell_id", F.posexplode(F.array(F.array_min(verts), F.array_max(verts))).alias("end", "v"))
        ends = ends.withColumn("which", F.col("cell_id").cast("long") * 2 + F.col("end"))
        lines = raster.select(F.col(line).cast("long").alias("line"), F.col(axis).alias("v")).distinct()
        near = nearest(ends.select("which", "v"), lines, ["v"], "which", "line")
        lo = F.min(F.when(F.col("which") % 2 == 0, F.col("line"))) - padding
        hi = F.max(F.when(F.col("which") % 2 != 0, F.col("line"))) + padding
        wanted.append(near.groupBy(F.expr("which div 2").alias("cell_id")).agg(lo.alias(f"{line}0"), hi.alias(f"{line}1")))
    own = cells.select(F.col("cell_id").cast("long").alias("cell_id"), "lat_verts", "lon_verts")
    return own.join(wanted[0], "cell_id").join(wanted[1], "cell_id")


def boxed(raster: DataFrame, boxes_: DataFrame) -> DataFrame:
    """Raster nodes (i, j, lat, lon, z) of each box with indices from the box's corner; an equi-join on blocks of BLOCK x BLOCK nodes."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    wide = boxes_.withColumn("bi", F.explode(F.sequence(block("i0"), F.floor((F.col("i1") - 1) / BLOCK)))).withColumn("bj", F.explode(F.sequence(block("j0"), F.floor((F.col("j1") - 1) / BLOCK))))
    nodes = raster.select("i", "j", "lat", "lon", "z").withColumns({"bi": block("i"), "bj": block("j")})
    inside = (F.col("i") >= F.col("i0")) & (F.col("i") < F.col("i1")) & (F.col("j") >= F.col("j0")) & (F.col("j") < F.col("j1"))
    met = nodes.join(wide, ["bi", "bj"]).where(inside)
    return met.select("cell_id", (F.col("i") - F.col("i0")).cast("int").alias("i"), (F.col("j") - F.col("j0")).cast("int").alias("j"), "lat", "lon", "z")


def origins(points: DataFrame, centre: bool = True) -> DataFrame:
    """(cell_id, lat_ref, lon_ref, lat_origin, lon_origin): the box's first lines and the projection's origin, its middle or its corner."""
    lo = points.groupBy("cell_id").agg(F.min("lat").alias("lat_ref"), F.max("lat").alias("_lat1"), F.min("lon").alias("lon_ref"), F.max("lon").alias("_lon1"))
    at = lambda a, b: (F.col(a) + F.col(b)) / 2 if centre else F.col(a)
    return lo.withColumns({"lat_origin": at("lat_ref", "_lat1"), "lon_origin": at("lon_ref", "_lon1")}).drop("_lat1", "_lon1")


def metres(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(y, x): signed metres from a box's first lines; zonal ones along the parallel of the projection's origin."""
    y = (F.radians(lat) - F.radians("lat_ref")) * EARTH_M
    return y, (F.radians(lon) - F.radians("lon_ref")) * EARTH_M * F.cos(F.radians("lat_origin"))


def projected(points: DataFrame, origins_: DataFrame) -> DataFrame:
    """points with y and x in metres."""
    y, x = metres(F.col("lat"), F.col("lon"))
    return points.join(origins_, "cell_id").withColumns({"y": y, "x": x}).drop("lat_ref", "lon_ref", "lat_origin", "lon_origin")


def projected_vertices(boxes_: DataFrame, origins_: DataFrame) -> DataFrame:
    """(cell_id, vy, vx): the vertices in the metres of their box."""
    both = boxes_.select("cell_id", "lat_verts", "lon_verts").join(origins_, "cell_id")
    return both.select("cell_id", F.transform("lat_verts", lambda v: metres(v, F.lit(0.0))[0]).alias("vy"), F.transform("lon_verts", lambda v: metres(F.lit(0.0), v)[1]).alias("vx"))


def polygon_mask(points: DataFrame, vertices: DataFrame, own_range: bool = True) -> DataFrame:
    """points with ``inside``: whether the node lies in its cell's polygon, edges included.

    Grid and vertices are both put on [0, 1] first, the grid by its own range, the vertices by theirs or (not ``own_range``, as with a
    padded box) by the grid's.
    """
    ends = points.groupBy("cell_id").agg(*[f(c).alias(f"_{n}{c}") for c in "yx" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    both = points.join(ends, "cell_id").join(vertices, "cell_id")
    unit = lambda lo, hi: lambda v: (v - lo) / (hi - lo)
    for c in "yx":
        lo, hi = (F.col(f"_lo{c}"), F.col(f"_hi{c}"))
        both = both.withColumn(f"_u{c}", unit(lo, hi)(F.col(c)))
        a, b = (F.array_min(f"v{c}"), F.array_max(f"v{c}")) if own_range else (lo, hi)
        both = both.withColumn(f"_w{c}", F.transform(f"v{c}", unit(a, b)))
    inside = in_polygon_columns(F.col("_ux"), F.col("_uy"), F.col("_wx"), F.col("_wy"))
    return both.withColumn("inside", inside).drop(*[f"_{n}{c}" for c in "yx" for n in ("lo", "hi", "u", "w")], "vy", "vx")


def spacings(points: DataFrame) -> DataFrame:
    """(cell_id, wlat, wlon): mean spacings of the lattice in metres."""
    wide = lambda c, k: (F.max(c) - F.min(c)) / (F.count_distinct(k) - 1)
    return points.groupBy("cell_id").agg(wide("y", "i").alias("wlat"), wide("x", "j").alias("wlon"))


def metric_index(points: DataFrame, value: str, spacing: str, out: str, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """points with ``out``: ceil((value - smallest value) / spacing), the index that a fit on metres uses.

    Quotients are rounded to nine places first, so that a node on a multiple of the spacing keeps its index whatever the last digit is.
    """
    low = points.groupBy(*keys).agg(F.min(value).alias("_lo"))
    return points.join(low, list(keys)).withColumn(out, F.ceil(F.round((F.col(value) - F.col("_lo")) / F.col(spacing), 9)).cast("int")).drop("_lo")


def low_passed(points: DataFrame, scale: float = 5000.0) -> DataFrame:
    """The lattices (with wlat and wlon) without features below ``scale`` metres, demeaned."""
    return points.drop("z").join(lattices.low_passed(points, "wlat", "wlon", scale), ["cell_id", "i", "j"]).select(points.columns)


def segment(raster: DataFrame, cells: DataFrame, rect: bool = False, filtered: bool = True, padding: int = 0, centre: bool = True, taper: DataFrame | None = None, mask: Column | None = None) -> DataFrame:
    """(cell_id, i, j, y, x, z, wlat, wlon, inside): each cell's lattice, demeaned, on equal spacing, filtered, tapered and masked.

    ``raster`` has i, j, lat, lon, z with ascending axes; ``cells`` has cell_id and arrays lat_verts and lon_verts. ``rect`` takes the whole
    box. ``taper`` (cell_id, i, j, p) multiplies the lattice; ``mask`` is a condition on its p in place of the polygon. z is demeaned again over
    the points inside. Cells without nodes have no rows.
    """
    found = saved(boxes(cells, raster, padding), "boxes")
    nodes = saved(boxed(raster, found), "boxed")  # both are read by several branches of the plan
    at = saved(origins(nodes, centre), "origins")
    nodes = R.demeaned(projected(nodes, at).select("cell_id", "i", "j", "y", "x", "z"))
    equal = R.equidistant_resample(nodes, None, None, "y", "x")
    ends = nodes.groupBy("cell_id").agg(F.max("y").alias("_y1"), F.max("x").alias("_x1"), F.max("i").alias("_i1"), F.max("j").alias("_j1"), F.min("y").alias("_y0"), F.min("x").alias("_x0"))
    wide = lambda a: (F.col(f"_{a}1") - F.col(f"_{a}0")) / F.greatest(F.lit(1), F.col("_i1" if a == "y" else "_j1"))
    grid = ends.select("cell_id", wide("y").alias("wlat"), wide("x").alias("wlon"), F.col("_y0").alias("_y"), F.col("_x0").alias("_x"))
    out = equal.join(grid, "cell_id").withColumns({"y": F.col("_y") + F.col("i") * F.col("wlat"), "x": F.col("_x") + F.col("j") * F.col("wlon")})
    out = out.select(F.col("cell_id").cast("long").alias("cell_id"), "i", "j", "y", "x", "z", "wlat", "wlon")
    if filtered:
        out = low_passed(out)
    if taper is not None:
        out = out.join(taper.select("cell_id", "i", "j", "p"), ["cell_id", "i", "j"], "left").withColumn("p", F.coalesce("p", F.lit(0.0))).withColumn("z", F.col("z") * F.col("p"))
    if rect:
        out = out.withColumn("inside", F.lit(True))
    elif mask is not None:
        out = out.withColumn("inside", mask)
    else:
        out = polygon_mask(out, projected_vertices(found, at), own_range=padding == 0)
    mean = out.where("inside").groupBy("cell_id").agg(F.avg("z").alias("_mean"))
    return out.join(mean, "cell_id", "left").withColumn("z", F.when(F.col("inside"), F.col("z") - F.col("_mean")).otherwise(F.col("z"))).select("cell_id", "i", "j", "y", "x", "z", "wlat", "wlon", "inside")


def tapers(points: DataFrame, padding: int, steps: int, stencil: str = "OP", dt: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(cell_id, i, j, p): the mask ``inside`` of each lattice with ``padding`` nodes around it, diffused outwards."""
    return lattices.diffused(points, padding, steps, stencil, dt, scale)


def tapered_rectangles(raster: DataFrame, cells: DataFrame, padding: int, steps: int) -> DataFrame:
    """The recipe for quadrilaterals: the box's mask is tapered into the padding and multiplies the padded box."""
    p = tapers(segment(raster, cells, rect=True), padding, steps)
    return segment(raster, cells, rect=True, padding=padding, taper=p)


#: Where a taper counts as inside.
TAPERED = 1e-2


def tapered_polygons(raster: DataFrame, cells: DataFrame, padding: int, steps: int) -> DataFrame:
    """The recipe for other cells: the polygon's mask is tapered into the padding, multiplies the filtered padded box, and the points where it exceeds TAPERED count."""
    p = tapers(segment(raster, cells), padding, steps)
    return segment(raster, cells, padding=padding, taper=p, mask=F.col("p") > TAPERED)
