"""Least-squares Fourier fits as aggregations.

On a full rectangle with integer indices the basis is orthogonal: the Gram matrix is diagonal with N/2 (N for the constant),
so a fit is a grouped sum over points and modes, taken axis by axis. Sums by point are additive, so partial sums precede the shuffle, and
the mode table, whose size is a parameter, is the broadcast side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import amplitude, phase


def _axis_sums(points: DataFrame, modes: DataFrame, ni: int, nj: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, m_i, m_j and the other columns of ``modes``, re, im, n): sums of value times cosine and sine of each mode's phase.

    The phase is a sum over the axes, so values first add up along i for each (j, m_i), then along j: points meet nhi rows each, not nhi x nhj.
    """
    a, b = (F.lit(2 * math.pi) * F.col(m) * F.col(x) / F.lit(float(n)) for m, x, n in (("m_i", "i", ni), ("m_j", "j", nj)))
    lines = points.crossJoin(F.broadcast(modes.select("m_i").distinct())).groupBy(*keys, "j", "m_i").agg(F.sum(F.col("z") * F.cos(a)).alias("_c"), F.sum(F.col("z") * F.sin(a)).alias("_s"), F.count("*").alias("_n"))
    both = lines.join(F.broadcast(modes), "m_i")
    re, im = F.col("_c") * F.cos(b) - F.col("_s") * F.sin(b), F.col("_s") * F.cos(b) + F.col("_c") * F.sin(b)
    return both.groupBy(*keys, *modes.columns).agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.sum("_n").alias("n"))


def right_hand_side(points: DataFrame, columns: DataFrame, ni: int, nj: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of basis times value by column, and the number of points; i and j are whole numbers."""
    own = columns.select("col", "part", "k_idx", "l_idx", "m_i", "m_j")
    sums = _axis_sums(points, own, ni, nj, keys)
    return sums.select(*keys, *own.columns, F.when(F.col("part") == "cos", F.col("re")).otherwise(F.col("im")).alias("rhs"), "n")


def gram(points: DataFrame, columns: DataFrame, ni: int, nj: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of products of pairs of columns; for small bases. The pairs are formed once from the mode table and broadcast."""
    other = columns.select(F.col("col").alias("col2"), F.col("part").alias("part2"), F.col("m_i").alias("m_i2"), F.col("m_j").alias("m_j2"))
    pairs = columns.select("col", "part", "m_i", "m_j").join(F.broadcast(other), F.col("col") <= F.col("col2"))
    value = lambda part, p: F.when(F.col(part) == "cos", F.cos(p)).otherwise(F.sin(p))
    both = points.crossJoin(F.broadcast(pairs))
    product = value("part", phase("m_i", "m_j", "i", "j", ni, nj)) * value("part2", phase("m_i2", "m_j2", "i", "j", ni, nj))
    return both.groupBy(*keys, "col", "col2").agg(F.sum(product).alias("g"))


def rectangle_fit(points: DataFrame, columns: DataFrame, ni: int, nj: int, lam: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Coefficients of the regularised fit on a full ni x nj rectangle: rhs / (diagonal + lambda * mean diagonal).

    A rectangle with nodes missing raises no error here; callers check ``n`` against ni * nj.
    """
    rhs = right_hand_side(points, columns, ni, nj, keys)
    diagonal = F.when((F.col("m_i") == 0) & (F.col("m_j") == 0), F.col("n").cast("double")).otherwise(F.col("n") / 2.0)
    mean = columns.agg(F.avg(F.when((F.col("m_i") == 0) & (F.col("m_j") == 0), 1.0).otherwise(0.5)).alias("mean_share"))
    return rhs.crossJoin(F.broadcast(mean)).withColumn("a", F.col("rhs") / (diagonal + lam * F.col("mean_share") * F.col("n"))).drop("mean_share")


def spectrum(coefficients: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k_idx, l_idx, m_i, m_j, a_cos, a_sin, ampl) from long coefficients; a missing sine is 0."""
    part = lambda p: F.sum(F.when(F.col("part") == p, F.col("a")))
    out = coefficients.groupBy(*keys, "k_idx", "l_idx", "m_i", "m_j").agg(F.coalesce(part("cos"), F.lit(0.0)).alias("a_cos"), F.coalesce(part("sin"), F.lit(0.0)).alias("a_sin"))
    return out.withColumn("ampl", amplitude("a_cos", "a_sin"))


def reconstruction(points: DataFrame, modes: DataFrame, ni: int, nj: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """points with ``recon``, the sum over the modes (m_i, m_j, a_cos, a_sin) of each key; points of keys without modes fall away.

    A key's modes travel as one array, so points are neither multiplied nor grouped.
    """
    one = F.array_sort(F.collect_list(F.struct("m_i", "m_j", "a_cos", "a_sin"))).alias("_modes")
    lists = modes.groupBy(*keys).agg(one)
    joined = points.join(lists, list(keys)) if keys else points.crossJoin(F.broadcast(lists))

    def add(total, m):
        p = phase(m["m_i"], m["m_j"], "i", "j", ni, nj)
        return total + m["a_cos"] * F.cos(p) + m["a_sin"] * F.sin(p)

    return joined.withColumn("recon", F.aggregate("_modes", F.lit(0.0), add)).drop("_modes")


def periodogram(points: DataFrame, modes: DataFrame, ni: int, nj: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k_idx, l_idx, m_i, m_j, re, im, n, ampl) of the two-dimensional DFT of demeaned values, scaled by the number of nodes over two."""
    sums = _axis_sums(points, modes.select("k_idx", "l_idx", "m_i", "m_j"), ni, nj, keys)
    return sums.withColumn("ampl", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("n") / 2.0))
