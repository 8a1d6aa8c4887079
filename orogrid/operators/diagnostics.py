"""Errors and summaries by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse(points: DataFrame, keys: tuple[str, ...] = ("cell_id",), floor: float = -200.0) -> DataFrame:
    """Root mean square of z - recon and its share in percent of the range from ``floor`` to the peak (100 if that is not positive)."""
    out = points.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("z") - F.col("recon"), 2))).alias("rmse"), F.max("z").alias("peak"))
    top = F.when(F.col("peak") <= 0, 100.0).otherwise(F.col("peak"))
    return out.select(*keys, "rmse", (F.col("rmse") / (top - floor) * 100).alias("rel_rmse"))


def relative_errors(pairs: DataFrame, value: str, ref: str) -> DataFrame:
    """Percent errors of each row against its reference and against the reference of largest magnitude."""
    largest = pairs.agg(F.max_by(ref, F.abs(ref)).alias("_top"))
    return pairs.crossJoin(F.broadcast(largest)).withColumn("rel_err", (F.col(value) / F.col(ref) - 1) * 100).withColumn("max_err", (F.col(value) - F.col(ref)) / F.col("_top") * 100).drop("_top")


def flux_differences(variants: DataFrame, value: str, base: str, at: tuple[str, ...], variant: str = "variant", keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(variant, keys, rel_diff): the largest difference from the base variant over that one's largest magnitude (or 1 if it is 0).

    ``at`` names the columns that match values of two variants; each variant has one row for each.
    """
    own = variants.where(F.col(variant) == base).select(*keys, *at, F.col(value).alias("_base"))
    both = variants.where(F.col(variant) != base).join(own, [*keys, *at])
    norm = F.max(F.abs("_base"))
    return both.groupBy(variant, *keys).agg((F.max(F.abs(F.col(value) - F.col("_base"))) / F.when(norm == 0, 1.0).otherwise(norm)).alias("rel_diff"))


def improvements(errors: DataFrame, value: str, base: str, variant: str = "variant", keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(variant, keys, improvement): by how many percent the error of each other variant is below the base variant's; null without a positive base.

    With the isotropic variant as base, that of the selected one is the structure-only effect.
    """
    own = errors.where(F.col(variant) == base).select(*keys, F.col(value).alias("_base"))
    both = errors.where(F.col(variant) != base).join(own, list(keys))
    return both.select(variant, *keys, F.when(F.col("_base") > 0, (F.col("_base") - F.col(value)) / F.col("_base") * 100).alias("improvement"))


def radial_slope(power: DataFrame, bins: int = 32, low: float = 0.02, high: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """(alpha, stderr, r2, n_bins): a line through the means of log power in equal bins of log wavenumber.

    Rows outside the band and rows without positive finite power don't count; fewer than three bins give null.
    """
    band = power.where(F.col("kmag").between(low, high) & (F.col("power") > 0) & (F.col("power") < float("inf")))
    band = band.withColumn("lk", F.log("kmag")).withColumn("lp", F.log("power"))
    ends = band.groupBy(*keys).agg(F.min("lk").alias("_lo"), F.max("lk").alias("_hi"))
    band = band.join(ends, list(keys)) if keys else band.crossJoin(F.broadcast(ends))
    bin_ = F.least(F.floor((F.col("lk") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1))
    means = band.groupBy(*keys, bin_.alias("bin")).agg(F.avg("lk").alias("x"), F.avg("lp").alias("y"))
    fit = means.groupBy(*keys).agg(F.regr_slope("y", "x").alias("s"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.count("*").alias("n_bins"))
    err = F.sqrt(F.greatest((1 - F.col("r2")) * F.col("syy") / F.col("sxx") / (F.col("n_bins") - 2), F.lit(0.0)))
    return fit.where("n_bins >= 3").select(*keys, (-F.col("s")).alias("alpha"), err.alias("stderr"), "r2", "n_bins")


def histogram(points: DataFrame, value: str, low: float, width: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts in equal bins, the last closed on the right; values outside don't count."""
    inside = points.where(F.col(value).between(low, low + width * bins))
    return inside.groupBy(*keys, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
