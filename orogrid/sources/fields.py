"""Sources beyond plain scans: multi-record rasters, crops, regridding, synthetic terrain, batch plans."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import memory_gb
from ..operators.raster import block_mean, dense_ids


def multi_record_scan(records: DataFrame, lat: tuple[float, float], lon: tuple[float, float], pad: int = 0) -> DataFrame:
    """(lat, lon, z) of packed records (lat array, lon array, z array row-major) within bounds widened by ``pad`` mean spacings.

    Each record is exploded where it lies; the first record's value stands where records overlap, and the result is sorted.
    """
    spacing = lambda a: F.abs(F.element_at(a, -1) - F.element_at(a, 1)) / (F.size(a) - 1)
    rows = records.withColumns({"_dy": spacing("lat"), "_dx": spacing("lon"), "_n": F.size("lon")}).select("record", "lat", "lon", "_dy", "_dx", "_n", F.posexplode("z").alias("p", "z"))
    rows = rows.select("record", F.expr("lat[p div _n]").alias("lat"), F.expr("lon[cast(p % _n as int)]").alias("lon"), "z", "_dy", "_dx")
    inside = F.col("lat").between(F.lit(lat[0]) - pad * F.col("_dy"), F.lit(lat[1]) + pad * F.col("_dy")) & F.col("lon").between(F.lit(lon[0]) - pad * F.col("_dx"), F.lit(lon[1]) + pad * F.col("_dx"))
    return rows.where(inside & F.col("z").isNotNull()).groupBy("lat", "lon").agg(F.min_by("z", "record").alias("z"))


def packed(points: DataFrame, keys: tuple[str, ...] = ("record",)) -> DataFrame:
    """Long nodes (i, j, lat, lon, z) as one row a record with ascending axes and row-major values; a record is one tile.

    Nodes that a record lacks are null.
    """
    rows_, columns_ = points.select(*keys, "i", "lat").distinct(), points.select(*keys, "j", "lon").distinct()
    points = rows_.join(columns_, list(keys)).join(points.select(*keys, "i", "j", "z"), [*keys, "i", "j"], "left")
    rows = F.array_sort(F.collect_list(F.struct("i", "j", "z")))
    axis = lambda c: F.array_sort(F.collect_set(c))
    return points.groupBy(*keys).agg(axis("lat").alias("lat"), axis("lon").alias("lon"), rows.alias("m")).select(*keys, "lat", "lon", F.col("m")["z"].alias("z"))


def crop_and_downsample(raster: DataFrame, i: tuple[int, int], j: tuple[int, int], factor: int, fill: float | None = None, mask: Column | None = None) -> DataFrame:
    """The nodes of a box, masked ones set to ``fill`` first, trimmed to whole blocks and averaged."""
    box = raster.where(F.col("i").between(i[0], i[1] - 1) & F.col("j").between(j[0], j[1] - 1))
    if mask is not None:
        box = box.withColumn("z", F.when(mask, F.lit(fill)).otherwise(F.col("z")))
    return block_mean(box.withColumn("i", F.col("i") - i[0]).withColumn("j", F.col("j") - j[0]), factor, factor)


def regridded(line: DataFrame, spacing: float, keys: tuple[str, ...] = ("i",), x: str = "lon", z: str = "z") -> DataFrame:
    """Values at the multiples of ``spacing`` within each line's ends, linear between its neighbours. A key is one grid line."""
    own = Window.partitionBy(*keys).orderBy(x)
    step = line.withColumn("_x1", F.lead(x).over(own)).withColumn("_z1", F.lead(z).over(own))
    first = F.ceil(F.col(x) / spacing)
    last = F.when(F.col("_x1").isNull(), F.floor(F.col(x) / spacing)).otherwise(F.ceil(F.col("_x1") / spacing) - 1)
    step = step.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("_t", F.col("k") * spacing)
    value = F.when(F.col("_x1").isNull() | (F.col("_t") == F.col(x)), F.col(z)).otherwise(F.col(z) + (F.col("_z1") - F.col(z)) * (F.col("_t") - F.col(x)) / (F.col("_x1") - F.col(x)))
    return step.select(*keys, F.col("_t").alias(x), value.alias(z))


def common_axis(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (), x: str = "lon") -> DataFrame:
    """(keys, k, x): equally spaced values over the range that both axes share, as many as the shorter axis has there."""
    ends = lambda df, s: df.groupBy(*keys).agg(F.min(x).alias(f"_lo{s}"), F.max(x).alias(f"_hi{s}"), F.count_distinct(x).alias(f"_n{s}"))
    both = ends(a, "a").join(ends(b, "b"), list(keys)) if keys else ends(a, "a").crossJoin(F.broadcast(ends(b, "b")))
    lo, hi, n = F.greatest("_loa", "_lob"), F.least("_hia", "_hib"), F.least("_na", "_nb")
    out = both.where(lo <= hi).withColumns({"_lo": lo, "_hi": hi, "_n": n}).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    return out.select(*keys, "k", (F.col("_lo") + F.col("k") * (F.col("_hi") - F.col("_lo")) / F.greatest(F.lit(1), F.col("_n") - 1)).alias(x))


def on_axis(lines: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("lat",), x: str = "lon", z: str = "z") -> DataFrame:
    """(keys, k, x, z): each line's values at the targets (k, x), linear between its neighbours, null outside its ends. A key is one grid line."""
    every = lines.select(*keys).distinct().crossJoin(F.broadcast(targets.select("k", x)))
    both = lines.select(*keys, F.lit(None).cast("int").alias("k"), x, z).unionByName(every.withColumn(z, F.lit(None).cast("double")))
    before = Window.partitionBy(*keys).orderBy(x, F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(x, F.col("k").isNull()).rowsBetween(0, Window.unboundedFollowing)
    node = F.when(F.col("k").isNull(), F.struct(x, z))
    met = both.withColumns({"_a": F.last(node, True).over(before), "_b": F.first(node, True).over(after)}).where("k is not null")
    at = (F.col(x) - F.col(f"_a.{x}")) / (F.col(f"_b.{x}") - F.col(f"_a.{x}"))
    value = F.when(F.col(f"_a.{x}") == F.col(f"_b.{x}"), F.col(f"_a.{z}")).otherwise(F.col(f"_a.{z}") + at * (F.col(f"_b.{z}") - F.col(f"_a.{z}")))
    return met.select(*keys, "k", x, value.alias(z))


def bilinear(grid: DataFrame, targets: DataFrame, target_id: str, keys: tuple[str, ...] = ("cell_id",), fill: float = 0.0) -> DataFrame:
    """(keys, target_id, z): an equally spaced lattice (i, j, y, x, z) at the targets (y, x), ``fill`` outside it or where a corner is missing.

    Each target meets its four corners by an equi-join on their indices.
    """
    ends = grid.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in "yxij" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    spot = targets.join(ends, list(keys))
    for c, k in (("y", "i"), ("x", "j")):
        place = (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * (F.col(f"_hi{k}") - F.col(f"_lo{k}")) + F.col(f"_lo{k}")
        spot = spot.withColumn(f"_p{k}", place).withColumn(f"_f{k}", F.least(F.floor(f"_p{k}"), F.col(f"_hi{k}") - 1)).withColumn(f"_t{k}", F.col(f"_p{k}") - F.col(f"_f{k}"))
    corner = lambda a, b: F.struct((F.col("_fi") + a).cast("int").alias("i"), (F.col("_fj") + b).cast("int").alias("j"), ((F.col("_ti") if a else 1 - F.col("_ti")) * (F.col("_tj") if b else 1 - F.col("_tj"))).alias("w"))
    inside = F.col("_ti").between(0, 1) & F.col("_tj").between(0, 1)
    four = spot.select(*keys, target_id, inside.alias("_in"), F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select(*keys, target_id, "_in", "c.*")
    met = four.join(grid.select(*keys, "i", "j", "z"), [*keys, "i", "j"], "left")
    lost = F.max(((F.col("w") != 0) & F.col("z").isNull()).cast("int"))
    sums = met.groupBy(*keys, target_id).agg(F.sum(F.col("w") * F.col("z")).alias("_z"), lost.alias("_lost"), F.first("_in").alias("_in"))
    return sums.select(*keys, target_id, F.when(F.col("_in") & (F.col("_lost") == 0), F.col("_z")).otherwise(F.lit(fill)).alias("z"))


# fixed values: the waves of the idealised terrain, for which errors are published: (m_i, m_j, a_cos, a_sin)
IDEAL_MODES = [
    (11, 2, 0.0, 98.98173690978265), (8, 3, 8.433014164350961, 0.0), (10, 0, 0.0, 93.08411783814844),
    (2, 5, 0.0, 49.47140091294182), (7, -5, 90.22220430515803, 0.0), (7, -2, 0.0, 94.06385446195455),
    (4, 5, 53.61814744463018, 0.0), (5, 6, 77.76528195442526, 0.0), (11, -5, 0.0, 9.755399150421395),
    (2, -2, 96.5044479545187, 0.0), (7, -3, 50.77976418220279, 0.0), (6, -1, 6.986520582162603, 0.0),
    (7, 3, 0.0, 41.74652833400242), (4, -1, 94.12924911884826, 0.0), (10, -5, 87.81493341343514, 0.0),
    (9, -3, 56.98774143448841, 0.0), (9, 3, 25.29144444707756, 0.0), (11, 0, 96.55853709675661, 0.0),
    (1, 1, 0.0, 1.660601300193576), (2, 0, 3.8030910076267133, 0.0), (1, -2, 0.0, 98.95477317038849),
    (7, 2, 0.0, 4.4170285028579),
]


def spectral_terrain(spark: SparkSession, ni: int, nj: int, modes: list[tuple[int, int, float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, modes): a periodic ni x nj lattice with the sum of the modes (m_i, m_j, a_cos, a_sin); ``IDEAL_MODES`` if none are given."""
    table = spark.createDataFrame(IDEAL_MODES if modes is None else modes, "m_i int, m_j int, a_cos double, a_sin double")
    nodes = spark.range(ni * nj).select(F.lit(0).alias("cell_id"), F.expr(f"cast(id div {nj} as int)").alias("i"), (F.col("id") % nj).cast("int").alias("j"))
    p = 2 * math.pi * (F.col("m_i") * F.col("i") / float(ni) + F.col("m_j") * F.col("j") / float(nj))
    points = nodes.crossJoin(F.broadcast(table)).groupBy("cell_id", "i", "j").agg(F.sum(F.col("a_cos") * F.cos(p) + F.col("a_sin") * F.sin(p)).alias("z"))
    return points, table


def cosine_ramp(spark: SparkSession, n: int = 240, scale: float = 2000.0) -> DataFrame:
    """(i, j, z): -scale / 2 * cos of the sum of both axes, each over one turn."""
    axis = lambda c: F.col(c) * (2 * math.pi / (n - 1))
    nodes = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    return nodes.withColumn("z", -(scale / 2) * F.cos(axis("i") + axis("j")))


# fixed values: corners of the synthetic cells in shares of the extents (x, y), in order
CORNERS = {"mid": ((0, 0), (0.5, 1), (1, 0)), "left": ((0, 0), (0, 1), (0.5, 1)), "right": ((0.5, 1), (1, 1), (1, 0)), "lower": ((0, 0), (0, 1), (1, 0)), "upper": ((0, 1), (1, 1), (1, 0))}


def synthetic_cells(spark: SparkSession, x_max: float, y_max: float, kinds: tuple[str, ...] = ("mid", "left", "right"), inset: float = 1e-7) -> DataFrame:
    """(cell_id, kind, lat_verts, lon_verts): triangles in a box, isosceles (mid, left, right) or right-angled (lower, upper), their outer corners moved in by ``inset``."""
    move = lambda v, top: (inset if v == 0 else top - inset if v == 1 else v * top)
    rows = [(k, kind, [move(y, y_max) for _, y in CORNERS[kind]], [move(x, x_max) for x, _ in CORNERS[kind]]) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "cell_id long, kind string, lat_verts array<double>, lon_verts array<double>")


#: Share by which a worker's memory exceeds the estimate of a cell.
SAFETY = 1.5


def memory_batches(cells: DataFrame, budget_gb: float, lat: str = "lat", cell_id: str = "cell_id") -> DataFrame:
    """(cell_id, gb, batch_id, n_workers, worker_gb): cells by falling memory estimate; a batch ends before the cell with which the mean estimate
    times the number of cells before it would exceed the budget.

    ``n_workers`` workers of ``worker_gb`` (the mean estimate and a margin) fit the budget; a single one gets no more than it. Equal
    estimates (all cells below 60 degrees, for one) are one class with a count, ordered by cell id; the cut rule is a fold over the classes, which one task
    does, and each class is placed by its cuts.
    """
    rows = cells.select(cell_id, memory_gb(F.col(lat)).alias("gb"))
    classes = rows.groupBy("gb").agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions(F.desc("gb"))

    def fold(batches):
        batch, count, total = 0, 0, 0.0
        for part in batches:
            out = []  # gb, first rank, batch
            for gb, n in zip(part.column("gb").to_pylist(), part.column("n").to_pylist(), strict=True):
                at = 0
                while at < n:
                    if count and (total + gb) / (count + 1) * count > budget_gb:
                        batch, count, total = batch + 1, 0, 0.0
                    first, took = at, 0
                    while at < n and not (count and (total + gb) / (count + 1) * count > budget_gb):
                        count, total, at, took = count + 1, total + gb, at + 1, took + 1
                    out.append((gb, first, took, batch))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["gb", "first", "took", "batch_id"])

    cuts = classes.mapInArrow(fold, "gb double, first long, took long, batch_id long")
    order = dense_ids(rows.withColumn("_order", F.struct((-F.col("gb")).alias("g"), F.col(cell_id).alias("c"))), "_order", "_place")  # no class is numbered by one task
    base = order.groupBy("gb").agg(F.min("_place").alias("_base"))
    runs = cuts.groupBy("gb").agg(F.array_sort(F.collect_list(F.struct("first", "batch_id"))).alias("runs"))
    placed = order.join(base, "gb").withColumn("rank", F.col("_place") - F.col("_base")).join(runs, "gb").withColumn("batch_id", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)["batch_id"])
    mean = cuts.groupBy("batch_id").agg((F.sum(F.col("gb") * F.col("took")) / F.sum("took")).alias("mean"))
    workers = F.greatest(F.lit(1), F.floor(budget_gb / (F.col("mean") * SAFETY))).cast("int")
    mean = mean.withColumn("n_workers", workers).withColumn("worker_gb", F.when(F.col("n_workers") == 1, F.least(F.col("mean") * SAFETY, F.lit(float(budget_gb)))).otherwise(F.col("mean") * SAFETY))
    return placed.join(mean, "batch_id").select(cell_id, "gb", "batch_id", "n_workers", "worker_gb")
