"""Incremental one-mode fits over event time.

The right-hand side and the Gram matrix of a fit are sums over points, so a stream keeps them as aggregate state by window and
late points simply add; the two-by-two system is solved in the projection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _terms(points: DataFrame, ts: str, value: str, period_s: float) -> dict:
    phase = 2 * math.pi * (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6) / period_s
    c, s, z = F.cos(phase), F.sin(phase), F.col(value)
    return {"n": F.count("*"), "z": F.sum(z), "zc": F.sum(z * c), "zs": F.sum(z * s), "cc": F.sum(c * c), "cs": F.sum(c * s), "ss": F.sum(s * s)}


def normal_sums(points: DataFrame, keys: list, ts: str = "ts", value: str = "value", period_s: float = 86_400.0) -> DataFrame:
    """n, sums of value and of products with one mode's cosine and sine, by ``keys``."""
    return points.groupBy(*keys).agg(*[e.alias(n) for n, e in _terms(points, ts, value, period_s).items()])


def solved(sums: DataFrame, lam: float = 0.0) -> DataFrame:
    """``sums`` with a_cos and a_sin of the regularised two-column fit; null where the system is singular."""
    reg = lam * (F.col("cc") + F.col("ss")) / 2
    cc, ss = F.col("cc") + reg, F.col("ss") + reg
    det = cc * ss - F.col("cs") * F.col("cs")
    solve = lambda x: F.when(F.abs(det) > 1e-12, x / det)
    return sums.withColumn("a_cos", solve(F.col("zc") * ss - F.col("zs") * F.col("cs"))).withColumn("a_sin", solve(F.col("zs") * cc - F.col("zc") * F.col("cs")))


def windowed_fit(stream: DataFrame, window: str = "6 hours", watermark: str = "1 hour", ts: str = "ts", value: str = "value", period_s: float = 21_600.0, lam: float = 0.0) -> DataFrame:
    """A fit for every event-time window of a stream (or of a table); late points within the watermark still count."""
    return solved(normal_sums(stream.withWatermark(ts, watermark), [F.window(ts, window)], ts, value, period_s), lam)
