"""Tiled raster scans: tile bounds, pruning by cell extents, unions with first-wins, coarse graining on load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import bounds_name, tile_name, wrap_signed


def tile_grid(spark: SparkSession, degrees: int = 15) -> DataFrame:
    """(tile_id, row, column, lat_min, lat_max, lon_min, lon_max, name) of a global tiling: 288 tiles at 15 degrees."""
    rows, columns = 180 // degrees, 360 // degrees
    grid = spark.range(rows * columns).select(F.expr(f"cast(id div {columns} as int)").alias("row"), (F.col("id") % columns).cast("int").alias("column"), F.col("id").cast("int").alias("tile_id"))
    grid = grid.withColumn("lat_min", F.col("row") * float(degrees) - 90.0).withColumn("lon_min", F.col("column") * float(degrees) - 180.0)
    grid = grid.withColumn("lat_max", F.col("lat_min") + degrees).withColumn("lon_max", F.col("lon_min") + degrees)
    if degrees == 15:
        return grid.withColumn("name", tile_name("lat_max", "lon_min"))
    return grid.withColumn("name", bounds_name(dataset("lat_max"), "lat_max", "lat_min", "lon_min", "lon_max"))


def dataset(lat_max) -> Column:
    """The dataset of a 30-degree tile: the southernmost band is the polar one's."""
    return F.when(F.col(lat_max) <= -60, "REMA_BKG").otherwise("MERIT")


def widened(extents: DataFrame, by: float) -> DataFrame:
    """Extents with ``by`` degrees around them: clamped at the poles, wrapped at the dateline; a turn or more is the whole circle."""
    wide = F.col("lon_max") - F.col("lon_min") + F.when(F.col("lon_min") > F.col("lon_max"), 360.0).otherwise(0.0) + 2 * by
    out = extents.withColumn("_whole", wide >= 360.0)
    lon = lambda c, d: F.when(F.col("_whole"), F.lit(-180.0 if d < 0 else 180.0)).otherwise(wrap_signed(F.col(c) + d))
    bounds = {"lat_min": F.greatest(F.col("lat_min") - by, F.lit(-90.0)), "lat_max": F.least(F.col("lat_max") + by, F.lit(90.0)), "lon_min": lon("lon_min", -by), "lon_max": lon("lon_max", by)}
    return out.withColumns(bounds).drop("_whole")


def tiles_of(extents: DataFrame, degrees: int = 15) -> DataFrame:
    """``extents`` (with lat_min, lat_max, lon_min, lon_max) once for each tile that overlaps; the tile's key is exploded, not searched.

    An extent whose lon_min is above its lon_max crosses the dateline and takes both sides.
    """
    last_row, columns = 180 // degrees - 1, 360 // degrees
    row = lambda c: F.least(F.greatest(F.floor((F.col(c) + 90.0) / degrees), F.lit(0)), F.lit(last_row)).cast("int")
    column = lambda c: F.floor((F.col(c) + 180.0) / degrees).cast("int")
    end = F.when(F.col("lon_min") > F.col("lon_max"), column("lon_max") + columns).otherwise(column("lon_max"))
    end = F.least(end, column("lon_min") + columns - 1)
    out = extents.withColumn("row", F.explode(F.sequence(row("lat_min"), row("lat_max")))).withColumn("column", F.explode(F.sequence(column("lon_min"), F.greatest(column("lon_min"), end))))
    return out.withColumn("column", F.pmod("column", F.lit(columns)).cast("int")).withColumn("tile_id", (F.col("row") * columns + F.col("column")).cast("int"))


def pruned_scan(raster: DataFrame, extents: DataFrame, degrees: int = 15) -> DataFrame:
    """Raster points (tile_id, lat, lon, z) of each extent: an equi-join on tile_id, which prunes partitions, then the range."""
    wanted = tiles_of(extents, degrees).drop("row", "column")
    inside = (F.col("lat") >= F.col("lat_min")) & (F.col("lat") <= F.col("lat_max"))
    across = F.col("lon_min") > F.col("lon_max")
    lon = F.when(across, (F.col("lon") >= F.col("lon_min")) | (F.col("lon") <= F.col("lon_max"))).otherwise((F.col("lon") >= F.col("lon_min")) & (F.col("lon") <= F.col("lon_max")))
    return raster.join(wanted, "tile_id").where(inside & lon)


def merge_tiles(points: DataFrame, order: str = "tile_order", keys: tuple[str, ...] = ("lat", "lon"), value: str = "z") -> DataFrame:
    """One value a coordinate: that of the tile first in order."""
    return points.groupBy(*keys).agg(F.min_by(value, order).alias(value))


#: Below this latitude a box is coarse-grained by so many times the factor.
POLAR_LAT, POLAR_TIMES = -85.0, 5


def loaded(raster: DataFrame, extents: DataFrame, factor: int = 1, degrees: int = 15, padding: float = 0.0, key: str = "cell_id", polar_times: int = POLAR_TIMES) -> DataFrame:
    """(key, i, j, lat, lon, z): each extent's part of a tiled raster (tile_id, lat, lon, z), coarse-grained on load.

    Tiles are pruned by the extents, overlapping ones give the value of the lowest tile_id, longitudes east of a dateline that an extent
    crosses count on past 180, lines are numbered in ascending order and blocks of factor x factor nodes averaged, ``polar_times`` as large
    where the whole extent lies south of POLAR_LAT; blocks that are not full are dropped. Extents without nodes have no rows.
    """
    wide = widened(extents.select(key, "lat_min", "lat_max", "lon_min", "lon_max"), padding)
    nodes = pruned_scan(raster.select("tile_id", "lat", "lon", "z"), wide, degrees)
    lon = F.when((F.col("lon_min") > F.col("lon_max")) & (F.col("lon") < F.col("lon_min")), F.col("lon") + 360.0).otherwise(F.col("lon"))
    nodes = merge_tiles(nodes.withColumn("lon", lon), "tile_id", (key, "lat", "lon"))
    lines = [nodes.select(key, c).distinct().withColumn(k, F.row_number().over(Window.partitionBy(key).orderBy(c)) - 1) for k, c in (("i", "lat"), ("j", "lon"))]  # an axis is one grid line
    by = nodes.groupBy(key).agg(F.when(F.max("lat") < POLAR_LAT, factor * polar_times).otherwise(factor).alias("_by"))
    both = nodes.join(lines[0], [key, "lat"]).join(lines[1], [key, "lon"]).join(by, key)
    block = lambda c: F.expr(f"cast({c} div _by as int)")
    means = both.groupBy(key, block("i").alias("bi"), block("j").alias("bj"), "_by").agg(*[F.avg(c).alias(c) for c in ("lat", "lon", "z")], F.count("*").alias("_n"))
    return means.where(F.col("_n") == F.col("_by") * F.col("_by")).select(key, F.col("bi").alias("i"), F.col("bj").alias("j"), "lat", "lon", "z")


#: Sizes in bytes of a whole tile file.
TILE_BYTES = (1_000_000, 50_000_000)


def file_audit(spark: SparkSession, path: str, glob: str = "*.nc", bounds: tuple[int, int] = TILE_BYTES) -> DataFrame:
    """(name, length, verdict) of the files below ``path``: "too small", "too large" or "ok"; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    verdict = F.when(F.col("length") < bounds[0], "too small").when(F.col("length") > bounds[1], "too large").otherwise("ok")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", verdict.alias("verdict"))
