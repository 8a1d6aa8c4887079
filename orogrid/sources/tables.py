"""Rasters, series, vectors and meshes taken from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import col

NI, NJ = 50, 11


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table by name; names that it lacks are left out, as a by-name variable scan does."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def _nodes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_extendedprice", *more)
    return df.withColumn("i", (F.col("l_quantity") - 1).cast("int")).withColumn("j", F.round(F.col("l_discount") * 100).cast("int"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, z): a complete 50 x 11 lattice, the mean price by quantity and discount. Indices come from integers."""
    return _nodes(spark, sf_dir).groupBy("i", "j").agg(F.avg("l_extendedprice").alias("z"))


def cells_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, i, j, z): one lattice for each of three return flags."""
    cell = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return _nodes(spark, sf_dir, "l_returnflag").groupBy(cell.alias("cell_id"), "i", "j").agg(F.avg("l_extendedprice").alias("z"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, z): hourly means of events, t in hours since the epoch."""
    t = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    return read(spark, sf_dir, "events", "ts", "value").groupBy(t.alias("t")).agg(F.avg("value").alias("z"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, i, j, z): every embedding as an 8 x 8 field."""
    df = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("p", "z"))
    return df.select("cell_id", F.expr("cast(p div 8 as int)").alias("i"), (F.col("p") % 8).cast("int").alias("j"), F.col("z").cast("double").alias("z"))


def _latlon(key, balance) -> tuple:
    return (col(key) * 7.0 - 84.0, (col(balance) + 1000.0) / 11000.0 * 360.0 - 180.0)


def mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, lat, lon) from customers."""
    lat, lon = _latlon("c_nationkey", "c_acctbal")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), lat.alias("lat"), lon.alias("lon"))


def mesh_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, lat, lon) of cell centres from suppliers."""
    lat, lon = _latlon("s_nationkey", "s_acctbal")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), lat.alias("lat"), lon.alias("lon"))
