"""Nearest-neighbour and spatial joins as bin equi-joins; nothing is compared with everything."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..session import saved


#: Cells that a bin holds on average at the first radius, and from which on a bin is dealt out.
PER_BIN, LARGE_BIN = 2, 4096
#: Rounds that double the radius; later ones take ``STRIDE`` times the last.
DOUBLINGS, STRIDE = 8, 8.0
#: Halvings of the first radius for cells that fill a small part of their box; rows that may be broadcast.
HALVINGS, SMALL_SIDE = 5, 100_000


def _binned(rows: DataFrame, axes: list[str], radius: float, around: bool) -> DataFrame:
    """Bins of width ``radius`` by axis; with ``around`` each row stands in its own bin and all that touch it."""
    for k, a in enumerate(axes):
        bin_ = F.floor(F.col(a) / radius)
        rows = rows.withColumn(f"_b{k}", F.explode(F.sequence(bin_ - 1, bin_ + 1)) if around else bin_)
    return rows


def _finite(axes: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False)) for a in axes])


def _extents(rows: DataFrame, axes: list[str]) -> tuple[int, list[tuple[float, float]]]:
    """The number of rows with finite coordinates, and the ends of each axis over them."""
    ends = [f(a).alias(f"{f.__name__}{k}") for k, a in enumerate(axes) for f in (F.min, F.max)]
    row = rows.where(_finite(axes)).agg(F.count("*").alias("n"), *ends).head()
    return row["n"], [(float(row[f"min{k}"]), float(row[f"max{k}"])) for k in range(len(axes))] if row["n"] else []


def first_radius(cells: DataFrame, axes: list[str]) -> float:
    """A bin width at which a bin holds ``PER_BIN`` cells on average, from one row of extents and a count."""
    return _bin_width(*_extents(cells, axes))


def _bin_width(n: int, ends: list[tuple[float, float]]) -> float:
    filled = [hi - lo for lo, hi in ends if hi > lo]
    return (math.prod(filled) * PER_BIN / n) ** (1 / len(filled)) if filled else 1.0


def _filled_radius(cells: DataFrame, axes: list[str], radius: float, n: int) -> float:
    """``radius``, halved while a bin that is not empty holds more than ``PER_BIN`` cells: cells on a surface or on lines leave most bins empty."""
    tried = [radius / 2**k for k in range(HALVINGS + 1)]
    filled = cells.agg(*[F.approx_count_distinct(F.xxhash64(*[F.floor(F.col(a) / r) for a in axes])).alias(f"r{k}") for k, r in enumerate(tried)]).head()
    return next((r for k, r in enumerate(tried) if n <= PER_BIN * filled[f"r{k}"]), tried[-1])


def _shuffled(side: DataFrame, rows: int) -> DataFrame:
    """A side that is not broadcast if it may have more than ``SMALL_SIDE`` rows: a compressed file's bytes tell little of what its rows take in memory."""
    return side.hint("merge") if rows > SMALL_SIDE else side


def nearest(points: DataFrame, cells: DataFrame, axes: list[str], point_id: str, cell_id: str, radius: float | None = None, metric: str = "l1", exact: bool = True) -> DataFrame:
    """(point_id, cell_id, distance) of every point's nearest cell, by a search in boxes that grow.

    In each round points meet the cells within ``radius`` on every axis, found by an equi-join on bins of that width; the first one follows
    from the cells' density (``first_radius``). The side with fewer rows stands in all bins around its own. Cells of a bin that holds more than
    ``LARGE_BIN`` are dealt out to parts, which its points meet one by one. With ``exact`` a point is done when its best distance is no more than the
    radius, so that nothing closer can lie outside; without, when its box holds any cell (the box rule, whose winner may not be the nearest of
    all). Points not yet done go on to the next round, one written table each. The radius doubles, later it grows by ``STRIDE``, and it passes
    over what no point can need: the least gap between a point and the box of all cells. When it covers the extents of both sides every point is done.
    Equal places are searched for once, and of cells at one place the one with the smallest id stands for all.

    Every row of the points comes back: with a null cell and distance where a coordinate is null, NaN or infinite. Such cells are passed
    over. Ties go to the smaller cell id; points may repeat, and null ids are ids like others. Without a finite cell there are no rows.
    """
    here = points.select(point_id, *axes)
    none = here.select(point_id, F.lit(None).cast(cells.schema[cell_id].dataType).alias(cell_id), F.lit(None).cast("double").alias("distance"))
    n_cells, cell_ends = _extents(cells, axes)
    if not n_cells:
        return none.limit(0)
    n_left, ends = _extents(here, axes)
    lost = here.where(~_finite(axes)).select(point_id, F.lit(None).cast(cells.schema[cell_id].dataType).alias(cell_id), F.lit(None).cast("double").alias("distance"))
    if not n_left:
        return lost
    n_points, done = n_left, []
    wide = [max(a[1], b[1]) - min(a[0], b[0]) for a, b in zip(ends, cell_ends, strict=True)]
    reach = (sum(wide) if metric == "l1" else math.sqrt(sum(w * w for w in wide))) if exact else max(wide)
    reach = max(reach * (1 + 1e-9), 1e-300)
    size = max(abs(x) for e in (*ends, *cell_ends) for x in e)
    least = math.ldexp(max(size, reach), -50)  # bins are whole numbers
    left = saved(here.where(_finite(axes)).select(*axes).distinct(), "places")
    n_left = left.count()
    there = saved(cells.where(_finite(axes)).groupBy(*axes).agg(F.min(F.struct(cell_id))[cell_id].alias(cell_id)), "cells")
    if radius is None:
        radius = max(_bin_width(n_cells, cell_ends), least)
        n_cells = there.count()
        radius = _filled_radius(there, axes, radius, n_cells) if exact else radius
    radius = max(radius, least)
    there = there.select(cell_id, *[F.col(a).alias(f"_c{a}") for a in axes])
    names = [f"_b{k}" for k in range(len(axes))]
    beyond = F.greatest(*[F.greatest(lo - F.col(a), F.col(a) - hi, F.lit(0.0)) for a, (lo, hi) in zip(axes, cell_ends, strict=True)], F.lit(0.0))
    step = 0
    while n_left:
        around = n_left < n_cells  # the points stand in the bins around their own
        near = _binned(left, axes, radius, around)
        bins = _binned(there.withColumnsRenamed({f"_c{a}": a for a in axes}), axes, radius, not around).withColumnsRenamed({a: f"_c{a}" for a in axes})
        keys = names
        if n_cells > LARGE_BIN:
            large = bins.groupBy(*names).agg(F.ceil(F.count("*") / LARGE_BIN).cast("int").alias("_parts")).where("_parts > 1")
            bins = bins.join(large, names, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(cell_id), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
            near = near.join(large, names, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
            keys = [*names, "_part"]
        gaps = [F.abs(F.col(f"_c{a}") - F.col(a)) for a in axes]
        bins = _shuffled(bins, n_cells if around else n_cells * 3 ** len(axes))
        both = _shuffled(near, n_left * (3 ** len(axes) if around else 1)).join(bins, keys).where(reduce(lambda x, y: x & y, [g <= radius for g in gaps]))
        d = reduce(lambda x, y: x + y, gaps) if metric == "l1" else F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))
        best = both.groupBy(*axes).agg(F.min(F.struct(d.alias("distance"), F.col(cell_id).alias(cell_id))).alias("_m"))
        best = best.select(*axes, F.col(f"_m.{cell_id}").alias(cell_id), F.col("_m.distance").alias("distance"))
        best = _shuffled(best.where(F.col("distance") <= radius) if exact else best, n_left)
        met = saved(left.join(best, axes, "left").select(*axes, cell_id, "distance"), "nearest")
        done.append(met.where("distance is not null"))
        left = met.where("distance is null").select(*axes)
        n_left, gap = left.agg(F.count("*"), F.min(beyond)).head()
        if n_left and radius >= reach:
            raise ValueError(f"{n_left} points are left at a radius of {radius}, beyond all extents")
        step += 1
        radius = min(max(radius * (2 if step < DOUBLINGS else STRIDE), gap or 0.0), 2 * reach)
    found = _shuffled(reduce(DataFrame.unionByName, done), n_points)
    return lost.unionByName(here.where(_finite(axes)).join(found, axes).select(point_id, cell_id, "distance"))


def nearest_great_circle(points: DataFrame, cells: DataFrame, point_id: str, cell_id: str) -> DataFrame:
    """The nearest cell on the sphere: chords order points as angles do, so the search is Euclidean in three axes.

    A point with a null, NaN or infinite coordinate has a null cell and distance; point_ids are unique.
    """
    def chord(df: DataFrame, key: str) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        return df.select(key, (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("w"))

    found = nearest(chord(points, point_id), chord(cells, cell_id), ["x", "y", "w"], point_id, cell_id, None, "l2").drop("distance")
    a, b = points.select(point_id, "lat", "lon"), cells.select(cell_id, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    a, b = (x.hint("merge") for x in (a, b))  # by the bytes of their files Spark may broadcast millions of rows
    return found.join(a, point_id, "left").join(b, cell_id, "left").select(point_id, cell_id, great_circle("lat", "lon", "lat2", "lon2").alias("distance"))


def scattered(points: DataFrame, values: DataFrame, keys: list[str], value: str, fill: float = 0.0) -> DataFrame:
    """``values`` on all of ``points``, ``fill`` where there is none."""
    return points.join(values, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
