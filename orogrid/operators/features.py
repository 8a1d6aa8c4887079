"""Checks of geographic features: statistics of a region's heights against the thresholds of its class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A check makes a Column from the statistics and the region's own thresholds.
Check = Callable[[], Column]


def _mountain() -> Column:
    return F.col("top") >= F.col("min_height")


def _lake() -> Column:
    return (F.col("low") < F.col("level") + 100) & (F.col("level_share") > 0.05)


def _water() -> Column:
    return (F.col("water_share") >= F.col("min_water")) & (F.col("mean_depth") >= F.col("min_depth"))


def _coast() -> Column:
    return (F.col("water_share") >= F.col("min_water")) & (F.col("land_share") >= F.col("min_land"))


CHECKS: dict[str, Check] = {"mountain": _mountain, "lake": _lake, "ocean": _water, "gulf": _water, "coast": _coast}


def region_stats(points: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Statistics by region of ``points`` (keys, z): extremes, mean, spread, shares of land, water, high ground and near the region's ``level``."""
    share = lambda c: F.avg(c.cast("double"))
    z = F.col("z")
    own = points.join(regions.select(*keys, "level", "tolerance"), list(keys))
    return own.groupBy(*keys).agg(
        F.max(z).alias("top"), F.min(z).alias("low"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("spread"), share(z > 1000).alias("high_share"), share(z < 0).alias("water_share"), share(z >= 0).alias("land_share"),
        F.coalesce(-F.avg(F.when(z < 0, z)), F.lit(0.0)).alias("mean_depth"), F.coalesce(share(F.abs(z - F.col("level")) < F.col("tolerance")), F.lit(0.0)).alias("level_share"),
    )


def checked_features(points: DataFrame, regions: DataFrame, checks: dict[str, Check] | None = None, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """The statistics of each region with its ``kind`` and whether it ``passed`` the check of that kind.

    ``regions`` has keys, kind, level, tolerance, min_height, min_water, min_depth and min_land, null where a kind does not use them.
    ``checks`` adds kinds or replaces theirs; a kind without a check fails as null.
    """
    passed = F.lit(None).cast("boolean")
    for kind, check in (CHECKS | (checks or {})).items():
        passed = F.when(F.col("kind") == kind, check()).otherwise(passed)
    return region_stats(points, regions, keys).join(regions, list(keys)).withColumn("passed", passed)
