"""Rasters, projections, predicates and meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import diagnostics, joins
from ..operators import raster as R
from ..sources import tables as T
from ..sources import tiles
from .base import CELLS, CENTRES, NODE, POINTS, RASTER, SERIES, register, rnd, rounded

TRIANGLE = [(0.0, 0.0), (1.0, 0.0), (0.5, 1.0)]


@register("raster_build", f"WITH {RASTER} SELECT i, j, {rnd('z')} AS z FROM raster")
def raster_build(spark, d):
    return rounded(T.raster(spark, d))


@register("block_mean", f"WITH {RASTER} SELECT i // 5 AS bi, j // 2 AS bj, {rnd('avg(z)')} AS z, {rnd('avg(i)')} AS ci, {rnd('avg(j)')} AS cj FROM raster GROUP BY 1, 2 HAVING count(*) = 10")
def block_mean(spark, d):
    nodes = T.raster(spark, d).withColumn("ci", F.col("i").cast("double")).withColumn("cj", F.col("j").cast("double"))
    return rounded(R.block_mean(nodes, 5, 2, ("z", "ci", "cj")))


_WINDOWS = "w AS (SELECT DISTINCT i AS a, j AS b FROM raster WHERE i % 2 = 0 AND j % 3 = 0)"


@register("window_means", f"WITH {RASTER}, {_WINDOWS} SELECT a AS i, b AS j, {rnd('avg(z)')} AS z FROM w JOIN raster ON i BETWEEN a AND a + 6 AND j BETWEEN b AND b + 3 GROUP BY 1, 2 HAVING count(*) = 28")
def window_means(spark, d):
    """Overlapping windows of 7 x 4 nodes, every second line and third column, from prefix sums; SQL adds up each window's nodes."""
    return rounded(R.window_means(T.raster(spark, d), 7, 4, 2, 3))


@register("block_mean_by_cell", f"WITH {CELLS} SELECT cell_id, i // 4 AS bi, j // 4 AS bj, {rnd('avg(z)')} AS z FROM cells GROUP BY 1, 2, 3 HAVING count(*) = 16")
def block_mean_by_cell(spark, d):
    return rounded(R.block_mean(T.cells_raster(spark, d), 4, 4, keys=("cell_id",)))


@register("demean_minmax", f"WITH {CELLS}, m AS (SELECT cell_id, avg(z) AS m, min(z) AS lo, max(z) AS hi FROM cells GROUP BY 1) SELECT cell_id, i, j, {rnd('z - m', 5)} AS z, {rnd('(z - lo) / (hi - lo)')} AS unit FROM cells JOIN m USING (cell_id)")
def demean_minmax(spark, d):
    return rounded(R.demeaned(R.rescaled(T.cells_raster(spark, d), "z", "unit")).select("cell_id", "i", "j", "z", "unit"), z=5)


@register("axis_metres", f"""
WITH a AS (SELECT DISTINCT CAST(l_quantity AS INT) AS k, CAST(l_quantity AS DOUBLE) * 7.0 AS deg FROM lineitem),
     s AS (SELECT k, deg, radians(deg) - radians(lag(deg) OVER (ORDER BY k)) AS t FROM a),
     u AS (SELECT k, deg, coalesce(abs(t) * 6371000.0, 0) AS lat_step, coalesce(abs(t - 2 * pi() * round(t / (2 * pi()))) * 6371000.0 * cos(radians(45.0)), 0) AS lon_step FROM s)
SELECT k, {rnd('sum(lat_step) OVER (ORDER BY k)', 3)} AS lat_m, {rnd('sum(lon_step) OVER (ORDER BY k)', 3)} AS lon_m FROM u""")
def axis_metres(spark, d):
    axis = T.read(spark, d, "lineitem", "l_quantity").distinct().select(F.col("l_quantity").cast("int").alias("k"), (F.col("l_quantity") * 7.0).alias("deg"))
    lat = R.axis_metres(axis, "deg", "lat").withColumnRenamed("metres", "lat_m")
    return rounded(R.axis_metres(lat, "deg", "lon", 45.0).withColumnRenamed("metres", "lon_m").select("k", "lat_m", "lon_m"), 3)


@register("unwrap_phase", f"""
WITH a AS (SELECT DISTINCT CAST(l_quantity AS INT) AS k FROM lineitem), p AS (SELECT k, 2 * pi() * (k * 0.37 - floor(k * 0.37)) AS p FROM a),
     s AS (SELECT k, p, coalesce(round((p - lag(p) OVER (ORDER BY k)) / (2 * pi())), 0) AS turns FROM p)
SELECT k, {rnd('p - 2 * pi() * sum(turns) OVER (ORDER BY k)')} AS unwrapped FROM s""")
def unwrap_phase(spark, d):
    axis = T.read(spark, d, "lineitem", "l_quantity").distinct().select(F.col("l_quantity").cast("int").alias("k"))
    phase = axis.withColumn("p", geo.TWO_PI * (F.col("k") * 0.37 - F.floor(F.col("k") * 0.37)))
    return rounded(R.unwrapped(phase, "p").select("k", "unwrapped"))


@register("bbox_slice", f"WITH {RASTER}, e AS (SELECT arg_min(i, abs(i - 10.4)) AS i0, arg_min(i, abs(i - 30.6)) AS i1, arg_min(j, abs(j - 2.2)) AS j0, arg_min(j, abs(j - 7.9)) AS j1 FROM raster) SELECT i, j, {rnd('z')} AS z FROM raster, e WHERE i >= i0 - 2 AND i < i1 + 2 AND j >= j0 - 2 AND j < j1 + 2")
def bbox_slice(spark, d):
    return rounded(R.bbox_slice(T.raster(spark, d), (10.4, 30.6), (2.2, 7.9), pad=2))


@register("padded_range", f"WITH {RASTER} SELECT i, j, {rnd('z')} AS z FROM raster WHERE i BETWEEN 12 - 3 AND 20 + 3")
def padded_range(spark, d):
    return rounded(R.padded_range(T.raster(spark, d), "i", 12, 20, 1.0, 3))


@register("nearest_index", f"WITH {SERIES} SELECT CAST(arg_min(t, abs(z - 50.0)) AS BIGINT) AS t FROM (SELECT t, z FROM series ORDER BY t)")
def nearest_index(spark, d):
    return R.nearest_index(T.series(spark, d), "z", 50.0, "t").select(F.col("t").cast("long").alias("t"))


IN_TRIANGLE = """(CASE WHEN y = 0.0 AND x BETWEEN 0.0 AND 1.0 THEN true WHEN (x - 1.0) * 1.0 - y * (-0.5) = 0 AND y BETWEEN 0.0 AND 1.0 AND x BETWEEN 0.5 AND 1.0 THEN true
  WHEN (x - 0.5) * (-1.0) - (y - 1.0) * (-0.5) = 0 AND y BETWEEN 0.0 AND 1.0 AND x BETWEEN 0.0 AND 0.5 THEN true
  ELSE (CAST((0.0 > y) <> (1.0 > y) AND 1.0 + y * (-0.5) / 1.0 < x AS INT) + CAST((1.0 > y) <> (0.0 > y) AND 0.5 + (y - 1.0) * (-0.5) / (-1.0) < x AS INT)) % 2 = 1 END)"""


def inside_triangle(points):
    """``points`` with ``inside``: node indices on the unit square, in the triangle that fills it."""
    return points.withColumn("x", F.col("i") / 49.0).withColumn("y", F.col("j") / 10.0).withColumn("inside", geo.in_polygon("x", "y", TRIANGLE))


@register("point_in_triangle", f"WITH {RASTER}, p AS (SELECT i, j, i / 49.0 AS x, j / 10.0 AS y FROM raster) SELECT i, j, {IN_TRIANGLE} AS inside FROM p")
def point_in_triangle(spark, d):
    return inside_triangle(T.raster(spark, d)).select("i", "j", "inside")


@register("triangle_mask_stats", f"WITH {CELLS}, p AS (SELECT *, i / 49.0 AS x, j / 10.0 AS y FROM cells), q AS (SELECT cell_id, z FROM p WHERE {IN_TRIANGLE}) SELECT cell_id, count(*) AS n, {rnd('avg(z)', 4)} AS topo_mean, {rnd('max(z) - avg(z)', 4)} AS topo_peak, {rnd('stddev_pop(z)', 4)} AS spread FROM q GROUP BY 1")
def triangle_mask_stats(spark, d):
    inside = inside_triangle(T.cells_raster(spark, d)).where("inside")
    return rounded(inside.groupBy("cell_id").agg(F.count("*").alias("n"), F.avg("z").alias("topo_mean"), (F.max("z") - F.avg("z")).alias("topo_peak"), F.stddev_pop("z").alias("spread")), 4)


@register("clamp_fill", f"WITH {RASTER}, s AS (SELECT i, j, CASE WHEN i = 7 THEN -32767.0 ELSE z - 38000.0 END AS z FROM raster) SELECT i, j, {rnd('greatest(CASE WHEN z = -32767.0 THEN -500.0 ELSE z END, -500.0)')} AS z FROM s")
def clamp_fill(spark, d):
    shifted = T.raster(spark, d).withColumn("z", F.when(F.col("i") == 7, -32767.0).otherwise(F.col("z") - 38000.0))
    return rounded(R.clamped(shifted, fill=-32767.0))


DEMEANED = f"{CELLS}, c AS (SELECT cell_id, i, j, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM cells)"


@register("land_flag", f"WITH {DEMEANED} SELECT cell_id, {rnd('avg(CASE WHEN z <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS low_share, CAST(avg(CASE WHEN z <= 0.5 THEN 1.0 ELSE 0.0 END) <= 0.95 AS INT) AS is_land FROM c GROUP BY 1")
def land_flag(spark, d):
    return rounded(R.land_flags(R.demeaned(T.cells_raster(spark, d))))


@register("ocean_mask_stats", f"WITH {DEMEANED}, p AS (SELECT *, i / 49.0 AS x, j / 10.0 AS y FROM c) SELECT cell_id, count(*) AS n, {rnd('avg(z)', 4)} AS topo_mean, {rnd('max(z)', 4)} AS topo_peak FROM p WHERE {IN_TRIANGLE} AND z >= -200 GROUP BY 1")
def ocean_mask_stats(spark, d):
    inside = inside_triangle(R.demeaned(T.cells_raster(spark, d))).where("inside and z >= -200")
    return rounded(inside.groupBy("cell_id").agg(F.count("*").alias("n"), F.avg("z").alias("topo_mean"), F.max("z").alias("topo_peak")), 4)


@register("land_fraction_histogram", f"""
WITH {POINTS}, r AS (SELECT *, CASE WHEN lon < -60 THEN 0 WHEN lon < 60 THEN 1 ELSE 2 END AS land FROM points)
SELECT land, CAST(least(floor((lat + 90.0) / 5.0), 35) AS INT) AS bin, count(*) AS n FROM r GROUP BY 1, 2""")
def land_fraction_histogram(spark, d):
    rows = T.mesh_points(spark, d).withColumn("land", F.when(F.col("lon") < -60, 0).when(F.col("lon") < 60, 1).otherwise(2))
    return diagnostics.histogram(rows, "lat", -90.0, 5.0, 36, ("land",))


REGIONS = [("north_atlantic", 0.0, 60.0, -70.0, -10.0), ("south_pacific", -60.0, 0.0, -180.0, -80.0), ("indian", -40.0, 20.0, 40.0, 100.0)]
_REGIONS = "regions AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {e})" for n, a, b, c, e in REGIONS) + ") t(name, lat0, lat1, lon0, lon1))"


@register("region_counts", f"WITH {POINTS}, {_REGIONS} SELECT name, count(*) AS n, sum(CASE WHEN lat > 0 THEN 1 ELSE 0 END)::BIGINT AS n_north, {rnd('min(lon)')} AS west, {rnd('median(lon)')} AS mid FROM points JOIN regions ON lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1 GROUP BY 1")
def region_counts(spark, d):
    regions = spark.createDataFrame(REGIONS, "name string, lat0 double, lat1 double, lon0 double, lon1 double")
    inside = F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1"))
    rows = T.mesh_points(spark, d).join(F.broadcast(regions), inside)
    return rounded(rows.groupBy("name").agg(F.count("*").alias("n"), F.sum((F.col("lat") > 0).cast("long")).alias("n_north"), F.min("lon").alias("west"), F.percentile("lon", 0.5).alias("mid")))


@register("feature_checks", f"WITH {DEMEANED}, s AS (SELECT cell_id, min(z) AS lo, max(z) AS hi, avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END) AS land, count(CASE WHEN isnan(z) OR isinf(z) THEN 1 END) AS bad FROM c GROUP BY 1) SELECT cell_id, bad, CASE WHEN hi > 3000 AND land > 0.3 THEN 'mountain' WHEN land < 0.2 THEN 'ocean' ELSE 'coast' END AS feature, lo BETWEEN -11500 AND 9000 AND hi BETWEEN -11500 AND 9000 AS in_range FROM s")
def feature_checks(spark, d):
    z = F.col("z")
    s = R.demeaned(T.cells_raster(spark, d)).groupBy("cell_id").agg(F.min(z).alias("lo"), F.max(z).alias("hi"), F.avg((z > 0).cast("double")).alias("land"), F.count(F.when(F.isnan(z) | (F.abs(z) == float("inf")), 1)).alias("bad"))
    feature = F.when((F.col("hi") > 3000) & (F.col("land") > 0.3), "mountain").when(F.col("land") < 0.2, "ocean").otherwise("coast")
    return s.select("cell_id", "bad", feature.alias("feature"), (F.col("lo").between(-11500, 9000) & F.col("hi").between(-11500, 9000)).alias("in_range"))


@register("nearest_cell_l1", f"WITH {POINTS}, {CENTRES}, x AS (SELECT point_id, cell_id, abs(c.lat - p.lat) + abs(c.lon - p.lon) AS d, row_number() OVER (PARTITION BY point_id ORDER BY abs(c.lat - p.lat) + abs(c.lon - p.lon), cell_id) AS rn FROM points p, centres c) SELECT point_id, cell_id, {rnd('d')} AS distance FROM x WHERE rn = 1")
def nearest_cell_l1(spark, d):
    return rounded(joins.nearest(T.mesh_points(spark, d), T.mesh_cells(spark, d), ["lat", "lon"], "point_id", "cell_id", 4.0))


@register("nearest_cell_box", f"""
WITH {POINTS}, {CENTRES}, x AS (SELECT point_id, cell_id, greatest(abs(c.lat - p.lat), abs(c.lon - p.lon)) AS m, abs(c.lat - p.lat) + abs(c.lon - p.lon) AS d FROM points p, centres c),
     r AS (SELECT CAST(4.0 * pow(2, k) AS DOUBLE) AS r FROM range(12) t(k)), b AS (SELECT point_id, min(r) AS r FROM x JOIN r ON m <= r GROUP BY 1),
     y AS (SELECT point_id, cell_id, d, row_number() OVER (PARTITION BY point_id ORDER BY d, cell_id) AS rn FROM x JOIN b USING (point_id) WHERE m <= r)
SELECT point_id, cell_id, {rnd('d')} AS distance FROM y WHERE rn = 1""")
def nearest_cell_box(spark, d):
    return rounded(joins.nearest(T.mesh_points(spark, d), T.mesh_cells(spark, d), ["lat", "lon"], "point_id", "cell_id", 4.0, exact=False))


_ARC = "acos(greatest(-1.0, least(1.0, sin(radians(p.lat)) * sin(radians(c.lat)) + cos(radians(p.lat)) * cos(radians(c.lat)) * cos(radians(c.lon) - radians(p.lon)))))"


@register("nearest_great_circle", f"WITH {POINTS}, {CENTRES} SELECT point_id, {rnd(f'min({_ARC})', 5)} AS distance FROM points p, centres c GROUP BY 1")
def nearest_great_circle(spark, d):
    return rounded(joins.nearest_great_circle(T.mesh_points(spark, d), T.mesh_cells(spark, d), "point_id", "cell_id").select("point_id", "distance"), 5)


EXTENT = "e AS (SELECT cell_id, greatest(lat - 4, -90) AS lat_min, least(lat + 4, 90) AS lat_max, CASE WHEN lon - 6 < -180 THEN lon - 6 + 360 ELSE lon - 6 END AS lon_min, CASE WHEN lon + 6 > 180 THEN lon + 6 - 360 ELSE lon + 6 END AS lon_max FROM centres)"


def extents(cells):
    """Bounding boxes around centres; one that crosses the dateline has its west bound above its east bound."""
    return cells.select("cell_id", F.greatest(F.col("lat") - 4, F.lit(-90.0)).alias("lat_min"), F.least(F.col("lat") + 4, F.lit(90.0)).alias("lat_max"), geo.wrap_signed(F.col("lon") - 6).alias("lon_min"), geo.wrap_signed(F.col("lon") + 6).alias("lon_max"))


@register("tile_overlap_join", f"""
WITH {CENTRES}, {EXTENT}, t AS (SELECT r * 24 + c AS tile_id, r * 15.0 - 90 AS lat0, c * 15.0 - 180 AS lon0 FROM range(12) a(r), range(24) b(c))
SELECT CAST(tile_id AS INT) AS tile_id, count(*) AS n_cells FROM e JOIN t ON lat_min < lat0 + 15 AND lat_max >= lat0
 AND CASE WHEN lon_min <= lon_max THEN lon_min < lon0 + 15 AND lon_max >= lon0 ELSE lon_min < lon0 + 15 OR lon_max >= lon0 END GROUP BY 1""")
def tile_overlap_join(spark, d):
    return tiles.tiles_of(extents(T.mesh_cells(spark, d)), 15).groupBy("tile_id").agg(F.count("*").alias("n_cells"))


@register("region_slice", f"""
WITH {CENTRES}, {EXTENT}, {POINTS} SELECT cell_id, count(*) AS n, {rnd('avg(lat)')} AS lat FROM e JOIN points ON lat BETWEEN lat_min AND lat_max
 AND CASE WHEN lon_min <= lon_max THEN lon BETWEEN lon_min AND lon_max ELSE lon >= lon_min OR lon <= lon_max END GROUP BY 1""")
def region_slice(spark, d):
    row, column = F.floor((F.col("lat") + 90.0) / 15).cast("int"), F.pmod(F.floor((F.col("lon") + 180.0) / 15).cast("int"), F.lit(24))
    points = T.mesh_points(spark, d).withColumn("tile_id", (F.least(row, F.lit(11)) * 24 + column).cast("int"))
    return rounded(tiles.pruned_scan(points, extents(T.mesh_cells(spark, d))).groupBy("cell_id").agg(F.count("*").alias("n"), F.avg("lat").alias("lat")))


@register("tile_first_wins", f"WITH p AS (SELECT {NODE}, l_linenumber AS t, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2, 3) SELECT i, j, {rnd('arg_min(z, t)')} AS z FROM p GROUP BY 1, 2")
def tile_first_wins(spark, d):
    rows = T.read(spark, d, "lineitem", "l_quantity", "l_discount", "l_linenumber", "l_extendedprice")
    rows = rows.select((F.col("l_quantity") - 1).cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j"), "l_linenumber", "l_extendedprice")
    tiled = rows.groupBy("i", "j", "l_linenumber").agg(F.avg("l_extendedprice").alias("z"))
    return rounded(tiles.merge_tiles(tiled, "l_linenumber", ("i", "j")))


@register("tile_names", f"WITH {POINTS}, t AS (SELECT DISTINCT CAST(ceil(lat / 15.0) * 15 AS INT) AS lat, CAST(floor(lon / 15.0) * 15 AS INT) AS lon FROM points) SELECT lat, lon, 'ETOPO_2022_v1_15s_' || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || CASE WHEN lon < 0 THEN 'W' WHEN lon = 180 THEN 'W' ELSE 'E' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') || '_surface.nc' AS name FROM t")
def tile_names(spark, d):
    t = T.mesh_points(spark, d).select((F.ceil(F.col("lat") / 15.0) * 15).cast("int").alias("lat"), (F.floor(F.col("lon") / 15.0) * 15).cast("int").alias("lon")).distinct()
    return t.withColumn("name", geo.tile_name("lat", "lon"))


@register("dateline_flags", f"""
WITH {CENTRES}, v AS (SELECT cell_id, [lon - 6, lon + 6 - CASE WHEN lon + 6 > 180 THEN 360 ELSE 0 END, lon] AS lons FROM centres),
     w AS (SELECT cell_id, list_max(lons) - list_min(lons) AS span, list_transform(lons, lambda x: CASE WHEN x < 0 THEN x + 360 ELSE x END) AS up FROM v)
SELECT cell_id, (list_max(up) - list_min(up) < span) AND span > 180 AS crosses, {rnd('span')} AS span FROM w""")
def dateline_flags(spark, d):
    lon = F.col("lon")
    v = T.mesh_cells(spark, d).withColumn("lons", F.array(lon - 6, lon + 6 - F.when(lon + 6 > 180, 360).otherwise(0), lon))
    return rounded(v.select("cell_id", geo.crosses_dateline("lons").alias("crosses"), (F.array_max("lons") - F.array_min("lons")).alias("span")))


@register("memory_estimate", f"WITH {CENTRES} SELECT cell_id, {rnd('CASE WHEN abs(lat) < 60 THEN 10.0 WHEN abs(lat) >= 85 THEN 60.0 ELSE 10.0 * pow(1.0 / cos(radians(abs(lat))), 0.7) END')} AS gb FROM centres")
def memory_estimate(spark, d):
    return rounded(T.mesh_cells(spark, d).select("cell_id", geo.memory_gb("lat").alias("gb")))


@register("haversine", f"WITH {CENTRES} SELECT cell_id, {rnd('2 * 6373.0 * asin(sqrt(pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon) / 2), 2)))', 4)} AS km FROM centres")
def haversine(spark, d):
    return rounded(T.mesh_cells(spark, d).select("cell_id", geo.haversine_km("lat", "lon", F.lit(10.0), F.lit(20.0)).alias("km")), 4)


@register("dense_relabel", "WITH k AS (SELECT DISTINCT o_custkey FROM orders) SELECT o_custkey, CAST(dense_rank() OVER (ORDER BY o_custkey) AS BIGINT) AS new_id FROM k")
def dense_relabel(spark, d):
    return R.dense_ids(T.read(spark, d, "orders", "o_custkey").distinct(), "o_custkey", start=1)


@register("grid_compact", f"""
WITH {POINTS}, {CENTRES}, lattice AS (SELECT DISTINCT round(lat / 14.0) * 14.0 AS lat, round(lon / 30.0) * 30.0 AS lon FROM points),
     x AS (SELECT l.lat, l.lon, cell_id, row_number() OVER (PARTITION BY l.lat, l.lon ORDER BY abs(c.lat - l.lat) + abs(c.lon - l.lon), cell_id) AS rn FROM lattice l, centres c), u AS (SELECT DISTINCT cell_id FROM x WHERE rn = 1)
SELECT cell_id, CAST(dense_rank() OVER (ORDER BY cell_id) AS BIGINT) AS new_id FROM u""")
def grid_compact(spark, d):
    lattice = T.mesh_points(spark, d).select((F.round(F.col("lat") / 14.0) * 14.0).alias("lat"), (F.round(F.col("lon") / 30.0) * 30.0).alias("lon")).distinct()
    lattice = lattice.withColumn("point_id", F.concat_ws("/", "lat", "lon"))
    near = joins.nearest(lattice, T.mesh_cells(spark, d), ["lat", "lon"], "point_id", "cell_id", 8.0)
    return R.dense_ids(near.select("cell_id").distinct(), "cell_id", start=1)


@register("summary_stats", f"WITH {RASTER} SELECT count(*) AS n, {rnd('min(z)', 4)} AS lo, {rnd('max(z)', 4)} AS hi, {rnd('avg(z)', 4)} AS mean, {rnd('median(z)', 4)} AS mid, sum(CASE WHEN isnan(z) THEN 1 ELSE 0 END)::BIGINT AS nans FROM raster")
def summary_stats(spark, d):
    return rounded(T.raster(spark, d).agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg("z").alias("mean"), F.percentile("z", 0.5).alias("mid"), F.sum(F.isnan("z").cast("long")).alias("nans")), 4)


@register("resample_nearest", f"""
WITH {RASTER}, ti AS (SELECT t, arg_min(i, abs(i - t * 49.0 / 19)) AS i FROM range(20) a(t), (SELECT DISTINCT i FROM raster ORDER BY i) GROUP BY t),
     tj AS (SELECT t, arg_min(j, abs(j - t * 10.0 / 6)) AS j FROM range(7) a(t), (SELECT DISTINCT j FROM raster ORDER BY j) GROUP BY t)
SELECT CAST(ti.t AS INT) AS i, CAST(tj.t AS INT) AS j, {rnd('z')} AS z FROM raster JOIN ti USING (i) JOIN tj USING (j)""")
def resample_nearest(spark, d):
    nodes = T.raster(spark, d).withColumn("cell_id", F.lit(0)).withColumn("lat", F.col("i").cast("double")).withColumn("lon", F.col("j").cast("double"))
    return rounded(R.equidistant_resample(nodes, 20, 7).select("i", "j", "z"))


@register("compacted_links", """
WITH k AS (SELECT s_suppkey, dense_rank() OVER (ORDER BY s_suppkey) AS new_id FROM supplier WHERE s_acctbal > 0), l AS (SELECT DISTINCT l_suppkey AS cell_id, l_partkey % 97 AS neighbour FROM lineitem)
SELECT CAST(a.new_id AS BIGINT) AS cell_id, CAST(coalesce(b.new_id, 0) AS BIGINT) AS neighbour, count(*) AS n FROM l JOIN k a ON a.s_suppkey = l.cell_id LEFT JOIN k b ON b.s_suppkey = l.neighbour GROUP BY 1, 2""")
def compacted_links(spark, d):
    """The links of the suppliers that are kept, with both ends renumbered; 0 where the neighbour is gone."""
    cells = T.read(spark, d, "supplier", "s_suppkey", "s_acctbal").withColumnRenamed("s_suppkey", "cell_id")
    links = T.read(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 97).alias("neighbour")).distinct()
    _, found = R.compacted(cells, links, cells.where("s_acctbal > 0"))
    return found.groupBy("cell_id", "neighbour").agg(F.count("*").alias("n"))
