"""Segmentation, tiled loading, regridding and feature checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, segments
from ..operators import raster as R
from ..sources import fields, tiles
from ..sources import tables as T
from .base import RASTER, register, rnd, rounded

#: The lattice as half a degree by one degree, and a triangle around a centre for every supplier.
_GRID = f"{RASTER}, g AS (SELECT i, j, i * 0.5 AS lat, j * 1.0 AS lon, z FROM raster)"
_CENTRE = "ce AS (SELECT s_suppkey AS cell_id, 4.0 + s_suppkey % 17 AS c, 2.0 + s_suppkey % 6 AS o FROM supplier)"
_SEGMENT = f"""{_GRID}, {_CENTRE}, b AS (SELECT *, CAST(round((c - 2.1) / 0.5) AS INT) AS i0, CAST(round((c + 2.3) / 0.5) AS INT) AS i1, CAST(round(o - 1.4) AS INT) AS j0, CAST(round(o + 1.2) AS INT) AS j1 FROM ce),
 r AS (SELECT *, 6371000.0 * radians(0.5) AS wlat, 6371000.0 * radians(1.0) * cos(radians((i0 + i1 - 1) * 0.25)) AS wlon FROM b),
 n AS (SELECT cell_id, wlat, wlon, g.i - i0 AS i, g.j - j0 AS j, (g.i - i0) * 1.0 / (i1 - i0 - 1) AS y, (g.j - j0) * 1.0 / (j1 - j0 - 1) AS x, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM r JOIN g ON g.i >= i0 AND g.i < i1 AND g.j >= j0 AND g.j < j1),
 k AS (SELECT *, y = 0 OR (((0 > y) <> (1 > y) AND 1 + (y - 0) * (1.7 / 2.6 - 1) / (1 - 0) < x)::INT + ((1 > y) <> (0 > y) AND 1.7 / 2.6 + (y - 1) * (0 - 1.7 / 2.6) / (0 - 1) < x)::INT) % 2 = 1 AS inside FROM n)"""


def grid(spark, d):
    return T.raster(spark, d).withColumns({"lat": F.col("i") * 0.5, "lon": F.col("j") * 1.0})


def triangles(spark, d):
    c, o = F.lit(4.0) + F.col("s_suppkey") % 17, F.lit(2.0) + F.col("s_suppkey") % 6
    return T.read(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").cast("long").alias("cell_id"), F.array(c - 2.1, c - 2.1, c + 2.3).alias("lat_verts"), F.array(o - 1.4, o + 1.2, o + 0.3).alias("lon_verts"))


@register("segment_points", f"WITH {_SEGMENT} SELECT cell_id, i, j, {rnd('i * wlat', 3)} AS y, {rnd('j * wlon', 3)} AS x, {rnd('CASE WHEN inside THEN z - avg(z) FILTER (WHERE inside) OVER (PARTITION BY cell_id) ELSE z END', 4)} AS z, {rnd('wlat', 3)} AS wlat, {rnd('wlon', 3)} AS wlon, inside FROM k")
def segment_points(spark, d):
    """Every cell's lattice in metres, demeaned, with the points inside its triangle."""
    return rounded(segments.segment(grid(spark, d), triangles(spark, d), filtered=False), 3, z=4)


@register("metric_indices", f"WITH {_SEGMENT} SELECT cell_id, i, j, i AS ii, j AS jj FROM k WHERE y = 0 OR inside")
def metric_indices(spark, d):
    """Indices on metres, counted from each cell's first point inside."""
    inside = segments.segment(grid(spark, d), triangles(spark, d), filtered=False).where("inside").select("cell_id", "i", "j", "y", "x", "wlat", "wlon")
    both = segments.metric_index(segments.metric_index(inside, "y", "wlat", "ii"), "x", "wlon", "jj")
    return both.select("cell_id", "i", "j", "ii", "jj")


@register("vertex_projection", f"""
WITH {_SEGMENT}, v AS (SELECT *, unnest([0, 1, 2]) AS vertex FROM r), p AS (SELECT *, [c - 2.1, c - 2.1, c + 2.3][vertex + 1] AS lat, [o - 1.4, o + 1.2, o + 0.3][vertex + 1] AS lon FROM v)
SELECT cell_id, vertex, {rnd('6371000.0 * (radians(lat) - radians(i0 * 0.5))', 3)} AS vy, {rnd('6371000.0 * (radians(lon) - radians(j0 * 1.0)) * cos(radians((i0 + i1 - 1) * 0.25))', 3)} AS vx FROM p""")
def vertex_projection(spark, d):
    """Each triangle's vertices in signed metres from the first lines of its box."""
    raster = grid(spark, d)
    found = segments.boxes(triangles(spark, d), raster)
    v = segments.projected_vertices(found, segments.origins(segments.boxed(raster, found)))
    v = v.select("cell_id", F.posexplode(F.arrays_zip("vy", "vx")).alias("vertex", "v"))
    return rounded(v.select("cell_id", "vertex", "v.vy", "v.vx"), 3)


@register("tapered_cells")
def tapered_cells(spark, d):
    """Both taper recipes: rectangles and triangles, filtered, with a tapered border."""
    raster, cells = grid(spark, d), triangles(spark, d)
    cells = cells.where("cell_id % 17 between 3 and 12 and cell_id % 6 between 1 and 4")  # boxes with room for a border inside the lattice
    both = [f(raster, cells, 1, 20).withColumn("recipe", F.lit(n)) for n, f in (("rectangle", segments.tapered_rectangles), ("polygon", segments.tapered_polygons))]
    return rounded(both[0].unionByName(both[1]), 3)


_TILED = "t AS (SELECT CAST(floor((lat + 90) / 15) * 24 + floor((lon + 180) / 15) AS INT) AS tile_id, lat, lon, avg(z) AS z FROM (SELECT -89.75 + (CAST(l_quantity AS INT) % 30) * 0.5 AS lat, 170.25 + (l_orderkey % 40) * 0.5 AS lo, CASE WHEN lo > 180 THEN lo - 360 ELSE lo END AS lon, l_extendedprice AS z FROM lineitem) GROUP BY ALL)"


def tiled(spark, d):
    """A raster of half degrees by the south pole on both sides of the dateline, in tiles of 15 degrees."""
    lo = 170.25 + (F.col("l_orderkey") % 40) * 0.5
    nodes = T.read(spark, d, "lineitem", "l_quantity", "l_orderkey", "l_extendedprice").select((-89.75 + (F.col("l_quantity").cast("int") % 30) * 0.5).alias("lat"), F.when(lo > 180, lo - 360).otherwise(lo).alias("lon"), F.col("l_extendedprice").alias("z"))
    tile = (F.floor((F.col("lat") + 90) / 15) * 24 + F.floor((F.col("lon") + 180) / 15)).cast("int")
    return nodes.groupBy("lat", "lon").agg(F.avg("z").alias("z")).withColumn("tile_id", tile)


_EXTENTS = [(0, -89.9, -86.0, 172.0, 178.0), (1, -85.0, -77.0, 175.0, -172.0), (2, -88.0, -80.0, -179.5, -171.0)]


@register("tiles_loaded", f"""
WITH {_TILED}, e AS (SELECT * FROM (VALUES {', '.join(map(str, _EXTENTS))}) x(cell_id, s, n, w, o)),
     p AS (SELECT cell_id, lat, CASE WHEN w > o AND lon < w - 0.5 THEN lon + 360 ELSE lon END AS lon, z FROM t, e WHERE lat BETWEEN s - 0.5 AND n + 0.5 AND CASE WHEN w - 0.5 > o + 0.5 OR w - 0.5 < -180 THEN (lon >= CASE WHEN w - 0.5 < -180 THEN w + 359.5 ELSE w - 0.5 END OR lon <= o + 0.5) ELSE lon BETWEEN w - 0.5 AND o + 0.5 END),
     q AS (SELECT * FROM p),
     f AS (SELECT cell_id, CASE WHEN max(lat) < -85 THEN 10 ELSE 2 END AS f FROM q GROUP BY 1),
     k AS (SELECT q.cell_id, f, lat, lon, z, dense_rank() OVER (PARTITION BY q.cell_id ORDER BY lat) - 1 AS i, dense_rank() OVER (PARTITION BY q.cell_id ORDER BY lon) - 1 AS j FROM q JOIN f ON q.cell_id = f.cell_id)
SELECT CAST(cell_id AS BIGINT) AS cell_id, CAST(i // f AS INT) AS i, CAST(j // f AS INT) AS j, {rnd('avg(lat)')} AS lat, {rnd('avg(lon)')} AS lon, {rnd('avg(z)', 4)} AS z FROM k GROUP BY 1, 2, 3, f HAVING count(*) = f * f""")
def tiles_loaded(spark, d):
    """Parts of a tiled raster for three extents with padding: by the pole, and across the dateline; means of 2 x 2 or (polar) 10 x 10 nodes."""
    extents = spark.createDataFrame(_EXTENTS, "cell_id long, lat_min double, lat_max double, lon_min double, lon_max double")
    return rounded(tiles.loaded(tiled(spark, d), extents, 2, padding=0.5), 6, z=4)


@register("tile_datasets", "WITH e AS (SELECT DISTINCT CAST(s_nationkey AS INT) AS n FROM supplier), b AS (SELECT n, n % 6 AS row, n % 12 AS col FROM e) SELECT n, CASE WHEN row = 0 THEN 'REMA_BKG' ELSE 'MERIT' END || '_' || CASE WHEN row * 30 - 60 < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(row * 30 - 60) AS VARCHAR), 2, '0') || '-' || CASE WHEN row * 30 - 90 < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(row * 30 - 90) AS VARCHAR), 2, '0') || '_' || CASE WHEN col * 30 - 180 < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(col * 30 - 180) AS VARCHAR), 3, '0') || '-' || CASE WHEN col * 30 - 150 < 0 THEN 'W' WHEN col = 11 THEN 'W' ELSE 'E' END || lpad(CAST(abs(col * 30 - 150) AS VARCHAR), 3, '0') || '.nc4' AS name FROM b")
def tile_datasets(spark, d):
    """File names of the 30-degree tiles of some extents; the southernmost band has another dataset."""
    e = T.read(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").cast("int").alias("n")).distinct()
    wanted = e.select("n", (F.col("n") % 6 * 12 + F.col("n") % 12).cast("int").alias("tile_id"))
    return wanted.join(F.broadcast(tiles.tile_grid(spark, 30)), "tile_id").select("n", "name")


@register("common_axis_regrid", f"""
WITH {RASTER}, a AS (SELECT i, j * 1.3 AS lon, z FROM raster WHERE i < 25), b AS (SELECT DISTINCT j * 1.1 + 0.4 AS lon FROM raster),
     e AS (SELECT greatest((SELECT min(lon) FROM a), (SELECT min(lon) FROM b)) AS lo, least((SELECT max(lon) FROM a), (SELECT max(lon) FROM b)) AS hi), t AS (SELECT k, lo + k * (hi - lo) / 10.0 AS lon FROM e, range(11) r(k)),
     s AS (SELECT i, lon AS x, z, lead(lon) OVER w AS x1, lead(z) OVER w AS z1 FROM a WINDOW w AS (PARTITION BY i ORDER BY lon))
SELECT i, CAST(k AS INT) AS k, {rnd('lon')} AS lon, {rnd('CASE WHEN lon = x THEN z ELSE z + (z1 - z) * (lon - x) / (x1 - x) END', 4)} AS z FROM s JOIN t ON lon >= x AND lon < x1""")
def common_axis_regrid(spark, d):
    """Lines of one dataset on the axis that it shares with another."""
    a = T.raster(spark, d).where("i < 25").select("i", (F.col("j") * F.lit(1.3)).alias("lon"), "z")
    b = T.raster(spark, d).select((F.col("j") * F.lit(1.1) + 0.4).alias("lon"))
    return rounded(fields.on_axis(a, fields.common_axis(a, b), ("i",)), 6, z=4)


@register("bilinear_compare", f"""
WITH {RASTER}, t AS (SELECT c_custkey AS id, (c_custkey % 53) * 0.97 AS y, (c_acctbal + 1000) / 1000 AS x FROM customer), f AS (SELECT *, least(floor(y), 48) AS fi, least(floor(x), 9) AS fj FROM t),
     c AS (SELECT id, y, x, fi + a AS i, fj + b AS j, (CASE WHEN a = 1 THEN y - fi ELSE 1 - (y - fi) END) * (CASE WHEN b = 1 THEN x - fj ELSE 1 - (x - fj) END) AS w FROM f, range(2) p(a), range(2) q(b))
SELECT id, {rnd('CASE WHEN any_value(y) <= 49 AND any_value(x) <= 10 THEN sum(w * z) ELSE 0 END', 4)} AS z FROM c LEFT JOIN raster USING (i, j) GROUP BY 1""")
def bilinear_compare(spark, d):
    """A lattice at scattered targets, 0 outside it."""
    lattice = T.raster(spark, d).select(F.lit(0).alias("cell_id"), "i", "j", F.col("i").cast("double").alias("y"), F.col("j").cast("double").alias("x"), "z")
    targets = T.read(spark, d, "customer", "c_custkey", "c_acctbal").select(F.lit(0).alias("cell_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 53 * 0.97).alias("y"), ((F.col("c_acctbal") + 1000) / 1000).alias("x"))
    return rounded(fields.bilinear(lattice, targets, "id").select("id", "z"), 4)


@register("feature_kinds", f"""
WITH p AS (SELECT c_nationkey AS region, c_acctbal AS z FROM customer), k AS (SELECT n_nationkey AS region, ['mountain', 'lake', 'ocean', 'gulf', 'coast'][n_nationkey % 5 + 1] AS kind, n_nationkey * 300.0 AS level FROM nation),
     s AS (SELECT region, kind, max(z) AS top, min(z) AS low, avg((z < 0)::INT) AS water, coalesce(-avg(z) FILTER (WHERE z < 0), 0) AS depth, avg((abs(z - level) < 400)::INT) AS near, any_value(level) AS level FROM p JOIN k USING (region) GROUP BY ALL)
SELECT region, kind, {rnd('water')} AS water_share, {rnd('depth', 4)} AS mean_depth, {rnd('near')} AS level_share,
       CASE kind WHEN 'mountain' THEN top >= 9900 WHEN 'lake' THEN low < level + 100 AND near > 0.05 WHEN 'coast' THEN water >= 0.05 AND 1 - water >= 0.2 ELSE water >= 0.1 AND depth >= 500 END AS passed FROM s""")
def feature_kinds(spark, d):
    """Nations as features of five kinds with their customers' balances as heights."""
    kinds = F.array(*[F.lit(x) for x in ("mountain", "lake", "ocean", "gulf", "coast")])
    regions = T.read(spark, d, "nation", "n_nationkey").select(
        F.col("n_nationkey").alias("region"), kinds[(F.col("n_nationkey") % 5).cast("int")].alias("kind"), (F.col("n_nationkey") * 300.0).alias("level"), F.lit(400.0).alias("tolerance"), F.lit(9900.0).alias("min_height"), F.lit(0.1).alias("min_water"), F.lit(500.0).alias("min_depth"), F.lit(0.2).alias("min_land")
    ).withColumn("min_water", F.when(F.col("kind") == "coast", 0.05).otherwise(F.col("min_water")))
    points = T.read(spark, d, "customer", "c_nationkey", "c_acctbal").select(F.col("c_nationkey").alias("region"), F.col("c_acctbal").alias("z"))
    return rounded(features.checked_features(points, regions).select("region", "kind", "water_share", "mean_depth", "level_share", "passed"), 6, mean_depth=4)


@register("padded_reader", f"WITH {RASTER}, g AS (SELECT i * 0.1 AS lat, j, z FROM raster) SELECT {rnd('lat', 3)} AS lat, j, {rnd('z', 4)} AS z FROM g WHERE lat BETWEEN 3.0 - 13 * 0.1 AND 3.4 + 13 * 0.1")
def padded_reader(spark, d):
    """A reader's box with padding and its tolerance, here of ten points."""
    lines = T.raster(spark, d).select((F.col("i") * F.lit(0.1)).alias("lat"), "j", "z")
    return rounded(R.padded_range(lines, "lat", 3.0, 3.4, 0.1, 3, 10), 3, z=4)
