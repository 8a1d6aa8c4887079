"""Mode tables, selection of modes and sets of modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def wavenumbers_l(nhj: int) -> tuple[int, int]:
    """First and last meridional wavenumber: -nhj/2+1 .. nhj/2 for even nhj, symmetric for odd."""
    return (-nhj // 2 + 1, nhj // 2) if nhj % 2 == 0 else (-(nhj - 1) // 2, (nhj - 1) // 2)


def mode_table(spark: SparkSession, nhi: int, nhj: int) -> DataFrame:
    """(k_idx, l_idx, m_i, m_j): nhi x nhj modes."""
    low, _ = wavenumbers_l(nhj)
    ids = spark.range(nhi * nhj)
    k, l = F.expr(f"cast(id div {nhj} as int)"), (F.col("id") % nhj).cast("int")  # noqa: E741
    return ids.select(k.alias("k_idx"), l.alias("l_idx"), k.alias("m_i"), (l + low).alias("m_j"))


def basis_columns(modes: DataFrame) -> DataFrame:
    """(col, part, k_idx, l_idx, m_i, m_j) of the dense basis: no cosine for k = 0, l < 0 and no sine for k = 0, l <= 0.

    Cosines come first, each part by (k, l); the mode table is a parameter's size, so one window numbers it.
    """
    cos = modes.where("not (m_i = 0 and m_j < 0)").withColumn("part", F.lit("cos"))
    sin = modes.where("not (m_i = 0 and m_j <= 0)").withColumn("part", F.lit("sin"))
    order = Window.partitionBy(F.lit(0)).orderBy("part", "k_idx", "l_idx")
    return cos.unionByName(sin).withColumn("col", (F.row_number().over(order) - 1).cast("int")).select("col", "part", "k_idx", "l_idx", "m_i", "m_j")


def top_modes(spectra: DataFrame, n: int, keys: tuple[str, ...] = ("cell_id",), ampl: str = "ampl") -> DataFrame:
    """The n strongest modes of each cell with their rank; NaN counts as 0, ties go to the smaller (l, k).

    Unlike repeated arg-max, which picks the first cell again once all are spent, picks are distinct by construction.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("_a"), "l_idx", "k_idx")
    ranked = spectra.withColumn("_a", F.nanvl(F.coalesce(F.col(ampl), F.lit(0.0)), F.lit(0.0))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).drop("_a")


def top_with_ties(spectra: DataFrame, n: int, keys: tuple[str, ...] = ("cell_id",), ampl: str = "ampl") -> DataFrame:
    """Modes at or above the n-th largest amplitude; ties at the cut stay."""
    return spectra.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(ampl)))).where(F.col("rank") <= n)


def distinct_padded(chosen: DataFrame, fallback: DataFrame, n: int, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """The first n different modes in order of choice, filled up from ``fallback`` in its order; both have a ``rank``."""
    both = chosen.select(*keys, "k_idx", "l_idx", F.struct(F.lit(0).alias("src"), F.col("rank").cast("long").alias("rank")).alias("o"))
    both = both.unionByName(fallback.select(*keys, "k_idx", "l_idx", F.struct(F.lit(1).alias("src"), F.col("rank").cast("long").alias("rank")).alias("o")))
    once = both.groupBy(*keys, "k_idx", "l_idx").agg(F.min("o").alias("o"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("rank") <= n).drop("o")


def jaccard(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """|a and b| / |a or b| of two sets of modes by key."""
    names = [*keys, "k_idx", "l_idx"]
    both = a.select(names).distinct().withColumn("a", F.lit(1)).unionByName(b.select(names).distinct().withColumn("b", F.lit(1)), allowMissingColumns=True)
    one = both.groupBy(names).agg(F.count("a").alias("a"), F.count("b").alias("b"))
    return one.groupBy(*keys).agg((F.sum(F.col("a") * F.col("b")) / F.count("*")).alias("jaccard"))


def restricted(table: DataFrame, pairs: DataFrame, recompute: bool = False, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """The modes of ``table`` whose (k_idx, l_idx) each key's ``pairs`` name, with nhi and nhj.

    With ``recompute`` the sizes shrink to the next even number above the largest index that is named; otherwise they are the table's.
    """
    even = lambda c: (F.max(c) + 1 + (F.max(c) + 1) % 2).cast("int")
    chosen = pairs.select(*keys, "k_idx", "l_idx").distinct().join(F.broadcast(table), ["k_idx", "l_idx"])
    whole = table.agg((F.max("k_idx") + 1).cast("int").alias("nhi"), (F.max("l_idx") + 1).cast("int").alias("nhj"))
    sizes = chosen.groupBy(*keys).agg(even("k_idx").alias("nhi"), even("l_idx").alias("nhj")) if recompute else whole
    both = chosen.join(sizes, list(keys)) if recompute and keys else chosen.crossJoin(F.broadcast(sizes))
    return both.select(*keys, "k_idx", "l_idx", "m_i", "m_j", "nhi", "nhj")


def coarse_spectrum(spectra: DataFrame, factor: int = 3, keys: tuple[str, ...] = ("cell_id",), values: tuple[str, ...] = ("kk", "ll"), ampl: str = "ampl") -> DataFrame:
    """(keys, bk, bl, ampl, values): means of blocks of factor x factor modes over those that are neither null nor NaN; wavenumbers of each block's middle mode."""
    middle = (F.col("k_idx") % factor == factor // 2) & (F.col("l_idx") % factor == factor // 2)
    block = [F.expr(f"cast({c} div {factor} as int)").alias(n) for c, n in (("k_idx", "bk"), ("l_idx", "bl"))]
    good = F.when(~F.isnan(ampl), F.col(ampl))
    return spectra.groupBy(*keys, *block).agg(F.avg(good).alias(ampl), *[F.max(F.when(middle, F.col(v))).alias(v) for v in values])
