"""Raster operators on long rasters (one row a node)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, col
from ..session import saved


def block_mean(raster: DataFrame, fi: int, fj: int, values: tuple[str, ...] = ("z",), keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over blocks of fi x fj nodes; blocks that are not full at the tail are dropped. Partial sums precede the shuffle."""
    bi, bj = F.expr(f"cast(i div {fi} as int)"), F.expr(f"cast(j div {fj} as int)")
    means = [F.avg(v).alias(v) for v in values]
    return raster.groupBy(*keys, bi.alias("bi"), bj.alias("bj")).agg(*means, F.count("*").alias("n")).where(F.col("n") == fi * fj).drop("n")


def window_means(raster: DataFrame, hi: int, hj: int, si: int = 1, sj: int = 1, value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, value): means over windows of hi x hj nodes whose first node (i, j) is a multiple of the steps si and sj; they may overlap.

    Two-dimensional prefix sums, along j and then along i, are looked up at the four corners of each window: a node is a corner of at most four windows for
    each step, so the cost does not grow with their size. A null value counts as missing, and a window that is not full has no row. Nodes
    are unique and count from 0 on whole lattices: one with a line cut short loses the windows there.
    """
    if min(hi, hj, si, sj) < 1:
        raise ValueError("windows and steps have at least one node")
    along_j = Window.partitionBy(*keys, "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    along_i = Window.partitionBy(*keys, "j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    v, one = F.col(value).cast("double"), F.col(value).isNotNull().cast("long")
    lines = raster.select(*keys, "i", "j", F.sum(F.coalesce(v, F.lit(0.0))).over(along_j).alias("_s"), F.sum(one).over(along_j).alias("_n"))
    sums = lines.select(*keys, "i", "j", F.sum("_s").over(along_i).alias("_s"), F.sum("_n").over(along_i).alias("_n"))
    # the window at (a, b) has its corners at (a + hi - 1, b + hj - 1), (a - 1, b + hj - 1), (a + hi - 1, b - 1) and (a - 1, b - 1)
    corner = lambda di, dj, sign: F.struct((F.col("i") - di).cast("int").alias("i"), (F.col("j") - dj).cast("int").alias("j"), F.lit(sign).alias("sign"))
    corners = F.array(corner(hi - 1, hj - 1, 1), corner(-1, hj - 1, -1), corner(hi - 1, -1, -1), corner(-1, -1, 1))
    own = F.filter(corners, lambda c: (c["i"] >= 0) & (c["j"] >= 0) & (c["i"] % si == 0) & (c["j"] % sj == 0))
    met = sums.select(*keys, "_s", "_n", F.explode(own).alias("_c"))
    found = met.groupBy(*keys, F.col("_c.i").alias("i"), F.col("_c.j").alias("j")).agg(F.sum(F.col("_c.sign") * F.col("_s")).alias("_s"), F.sum(F.col("_c.sign") * F.col("_n")).alias("_n"), F.count("*").alias("_m"))
    corners_of = F.when((F.col("i") > 0) & (F.col("j") > 0), 4).when((F.col("i") > 0) | (F.col("j") > 0), 2).otherwise(1)
    whole = (F.col("_n") == hi * hj) & (F.col("_m") == corners_of)
    return found.where(whole).select(*keys, "i", "j", (F.col("_s") / F.col("_n")).alias(value))


def demeaned(points: DataFrame, keys: tuple[str, ...] = ("cell_id",), value: str = "z") -> DataFrame:
    """``value`` less its mean by key. The means are an aggregate joined back, so no window holds a cell."""
    mean = points.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return points.join(mean, list(keys)).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def rescaled(points: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("cell_id",), low: float | None = None, high: float | None = None) -> DataFrame:
    """``value`` on [0, 1] by its own or a given range."""
    if low is not None:
        return points.withColumn(out, (F.col(value) - low) / (high - low))
    ends = points.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return points.join(ends, list(keys)).withColumn(out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def axis_metres(axis: DataFrame, value: str, kind: str, fixed_lat: float | Column = 0.0, keys: tuple[str, ...] = (), order: str = "k") -> DataFrame:
    """Metres along an ordered axis of degrees, from 0. An axis is one grid line: small, and one partition a key."""
    own = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(order)
    step = F.abs(F.radians(F.col(value)) - F.radians(F.lag(value).over(own))) * EARTH_M
    if kind == "lon":
        turn = F.radians(F.col(value)) - F.radians(F.lag(value).over(own))
        turn = turn - 2 * math.pi * F.round(turn / (2 * math.pi))
        step = F.abs(turn) * EARTH_M * F.cos(F.radians(col(fixed_lat)))
    stepped = axis.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("metres", F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def unwrapped(series: DataFrame, value: str, keys: tuple[str, ...] = (), order: str = "k") -> DataFrame:
    """Phases without jumps of more than pi between neighbours."""
    own = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(order)
    jump = F.col(value) - F.lag(value).over(own)
    stepped = series.withColumn("_turns", F.coalesce(F.round(jump / (2 * math.pi)), F.lit(0.0)))
    return stepped.withColumn("unwrapped", F.col(value) - 2 * math.pi * F.sum("_turns").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_turns")


def nearest_index(axis: DataFrame, value: str, target: float | Column, index: str = "k") -> DataFrame:
    """(index) of the axis value nearest the target; the first on ties."""
    return axis.agg(F.min(F.struct(F.abs(F.col(value) - target).alias("d"), F.col(index).alias("k"))).alias("m")).select(F.col("m.k").alias(index))


def bbox_slice(raster: DataFrame, i_range: tuple[float, float], j_range: tuple[float, float], x: str = "i", y: str = "j", pad: int = 0) -> DataFrame:
    """Nodes from the index nearest each lower bound less ``pad`` up to, but not including, that nearest the upper bound plus ``pad``."""
    ends = raster.agg(*[
        F.min(F.struct(F.abs(F.col(c) - v), F.col(k))).getField(k).alias(name)
        for c, k, (lo, hi) in ((x, "i", i_range), (y, "j", j_range)) for name, v in ((f"{k}0", lo), (f"{k}1", hi))
    ])
    inside = (F.col("i") >= F.col("i0") - pad) & (F.col("i") < F.col("i1") + pad) & (F.col("j") >= F.col("j0") - pad) & (F.col("j") < F.col("j1") + pad)
    return raster.join(F.broadcast(ends), inside).drop("i0", "i1", "j0", "j1")


#: Points by which a reader widens its box beyond the padding asked for.
TOLERANCE = 50


def padded_range(points: DataFrame, column: str, low: float, high: float, spacing: float, pad: int, tolerance: int = 0) -> DataFrame:
    """Rows within the bounds widened by ``pad + tolerance`` spacings, both ends included; readers take ``TOLERANCE``."""
    by = (pad + tolerance) * spacing
    return points.where(F.col(column).between(low - by, high + by))


def clamped(points: DataFrame, value: str = "z", floor: float = -500.0, fill: float | None = None) -> DataFrame:
    """Values below the floor set to it, after fill values become the floor too."""
    z = F.col(value) if fill is None else F.when(F.col(value) == fill, F.lit(floor)).otherwise(F.col(value))
    return points.withColumn(value, F.greatest(z, F.lit(floor)))


def land_flags(points: DataFrame, keys: tuple[str, ...] = ("cell_id",), value: str = "z", height: float = 0.5, share: float = 0.95) -> DataFrame:
    """is_land by key: not more than ``share`` of the nodes are at or below ``height``."""
    low = F.avg((F.col(value) <= height).cast("double"))
    return points.groupBy(*keys).agg(low.alias("low_share")).withColumn("is_land", (F.col("low_share") <= share).cast("int"))


def dense_ids(rows: DataFrame, key: str, out: str = "new_id", start: int = 0) -> DataFrame:
    """Keys renumbered from ``start`` without gaps, in order.

    Distinct keys are range-partitioned, sorted and written once; ranges are numbered from the counts of the ranges before, one row a
    range, and meet them again by an equi-join on the range's number.
    """
    keys = rows.select(key).distinct()
    parts = keys.repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key).sortWithinPartitions(key)
    parts = saved(parts.withColumn("_p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_p").orderBy(key)) + F.col("_base") - 1 + start
    return rows.join(parts.join(base, "_p").select(key, number.cast("long").alias(out)), key)


def equidistant_resample(raster: DataFrame, ni: int | None, nj: int | None, x: str = "lat", y: str = "lon", keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Values at the nodes of an equidistant grid with the same ends, each from the nearest row and the nearest column.

    Nearest on a rectilinear grid separates by axis; ties take the smaller index. A size of None keeps each key's own number of lines.
    """
    def axis(k: str, c: str, n: int | None) -> DataFrame:
        line = raster.select(*keys, k, c).distinct()
        size = F.count("*") if n is None else F.lit(n)
        ends = line.groupBy(*keys).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), size.cast("int").alias("_size"))
        target = ends.withColumn(f"t{k}", F.explode(F.sequence(F.lit(0), F.col("_size") - 1))).withColumn("_v", F.col("_lo") + F.col(f"t{k}") * (F.col("_hi") - F.col("_lo")) / F.greatest(F.lit(1), F.col("_size") - 1))
        near = line.join(target, list(keys)).groupBy(*keys, f"t{k}").agg(F.min(F.struct(F.abs(F.col(c) - F.col("_v")).alias("d"), F.col(k).alias(k))).alias("m"))
        return near.select(*keys, f"t{k}", F.col(f"m.{k}").alias(k))

    return raster.join(axis("i", x, ni), [*keys, "i"]).join(axis("j", y, nj), [*keys, "j"]).select(*keys, F.col("ti").alias("i"), F.col("tj").alias("j"), "z")


def compacted(cells: DataFrame, links: DataFrame, keep: DataFrame, key: str = "cell_id", neighbour: str = "neighbour", start: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cells, links) of the keys in ``keep`` only, renumbered from ``start`` without gaps; a link to a cell that is gone has ``start`` - 1.

    ``links`` has a key and a neighbour, which are numbers of the same cells; links from cells that are gone fall away.
    """
    kept = dense_ids(cells.join(keep.select(key).distinct(), key, "left_semi"), key, "new_id", start)
    own = kept.select(key, "new_id")
    other = own.select(F.col(key).alias(neighbour), F.col("new_id").alias("_new"))
    found = links.join(own, key).join(other, neighbour, "left")
    return kept, found.select(F.col("new_id").alias(key), F.coalesce("_new", F.lit(start - 1)).cast("long").alias(neighbour), *[c for c in links.columns if c not in (key, neighbour)])
