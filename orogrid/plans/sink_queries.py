"""Result tables, chunks, triangles and pair errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster as R
from ..operators import sinks
from ..sources import tables as T
from .base import CELLS, RASTER, register, rnd, rounded

_REC = """rec AS (SELECT o_orderkey AS cell_id, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_land, o_totalprice AS clat, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice / 2 END AS clon,
 CASE WHEN o_orderstatus = 'O' THEN 1.0 END AS dk, CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '2-HIGH' THEN 1.0 END AS dl FROM orders)"""


def records(spark, d):
    """Cell records from orders: open ones are land, and some lack a field."""
    o = T.read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    land = F.col("o_orderstatus") == "O"
    return o.select(
        F.col("o_orderkey").alias("cell_id"), land.cast("int").alias("is_land"), F.col("o_totalprice").alias("clat"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 2).alias("clon"),
        F.when(land, 1.0).alias("dk"), F.when(land & (F.col("o_orderpriority") != "2-HIGH"), 1.0).alias("dl"), F.when(land, F.array(F.lit(0.0), F.col("o_totalprice"))).alias("h_spec"),
    )


@register("complete_flag", f"WITH {_REC} SELECT cell_id, clat IS NOT NULL AND clon IS NOT NULL AND (is_land = 0 OR (dk IS NOT NULL AND dl IS NOT NULL AND clat <> 0)) AS complete FROM rec")
def complete_flag(spark, d):
    return records(spark, d).select("cell_id", sinks.complete().alias("complete"))


@register("idempotent_append", f"WITH {_REC} SELECT CAST(cell_id // 100 AS INT) AS chunk, is_land, count(*) AS n FROM rec WHERE clon IS NOT NULL AND (is_land = 0 OR dl IS NOT NULL) GROUP BY 1, 2")
def idempotent_append(spark, d):
    """Records written in two overlapping runs by the keyed writer; each key is stored once."""
    from ..session import shared_path

    whole, path = records(spark, d).where(sinks.complete()), shared_path(spark, "records")
    sinks.append_missing(whole.where("is_land = 1"), path)
    return sinks.append_missing(whole, path).groupBy("chunk", "is_land").agg(F.count("*").alias("n"))


_CHUNKS = "kept AS (SELECT o_orderkey AS cell_id, o_orderkey // 100 AS chunk FROM orders WHERE o_orderstatus <> 'P'), chunks AS (SELECT chunk, min(cell_id) AS first_id, max(cell_id) AS last_id, count(*) AS n FROM kept GROUP BY 1)"


def chunks(spark, d):
    kept = T.read(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("cell_id"))
    return kept.groupBy(F.expr("cell_id div 100").alias("chunk")).agg(F.min("cell_id").alias("first_id"), F.max("cell_id").alias("last_id"), F.count("*").alias("n"))


@register("chunk_gaps", f"WITH {_CHUNKS}, g AS (SELECT coalesce(lag(last_id) OVER (ORDER BY first_id), -1) AS after, first_id AS before FROM chunks) SELECT * FROM g WHERE before <> after + 1")
def chunk_gaps(spark, d):
    return sinks.gaps(chunks(spark, d))


@register("chunk_counts", f"WITH {_CHUNKS} SELECT 'cells_' || first_id || '-' || last_id AS name, first_id, last_id, n, last_id - first_id + 1 - n AS n_missing FROM chunks")
def chunk_counts(spark, d):
    named = chunks(spark, d).select(F.format_string("cells_%d-%d", "first_id", "last_id").alias("name"), "n")
    first, last = geo.chunk_range("name")
    return named.select("name", first.alias("first_id"), last.alias("last_id"), "n", (last - first + 1 - F.col("n")).alias("n_missing"))


@register("merge_fill_missing", f"""
WITH k AS (SELECT o_orderkey AS cell_id, 1 AS is_land, o_totalprice AS clat, o_totalprice / 2 AS clon, o_custkey AS chunk_order FROM orders WHERE o_orderstatus = 'F'
           UNION ALL SELECT o_orderkey, 0, o_totalprice / 4, 1.5, o_custkey + 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'),
     l AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY chunk_order DESC) AS rn FROM k), e AS (SELECT range AS cell_id FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders)))
SELECT cell_id, l.cell_id IS NULL AS is_placeholder, coalesce(is_land, 0) AS is_land, {rnd('coalesce(clat, 0.0)')} AS clat, {rnd('coalesce(clon, 0.0)')} AS clon FROM e LEFT JOIN l USING (cell_id) WHERE coalesce(rn, 1) = 1""")
def merge_fill_missing(spark, d):
    o = T.read(spark, d, "orders")
    price = F.col("o_totalprice")
    first = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cell_id"), F.lit(1).alias("is_land"), price.alias("clat"), (price / 2).alias("clon"), F.col("o_custkey").alias("chunk_order"))
    later = o.where("o_orderstatus = 'F' and o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("cell_id"), F.lit(0).alias("is_land"), (price / 4).alias("clat"), F.lit(1.5).alias("clon"), (F.col("o_custkey") + 1).alias("chunk_order"))
    last = o.agg(F.max("o_orderkey")).head()[0] or 0
    return rounded(sinks.merged(first.unionByName(later), 0, last))


@register("missing_extra", "WITH k AS (SELECT o_orderkey AS cell_id FROM orders WHERE o_orderstatus <> 'P') SELECT r.range AS cell_id, 'missing' AS what FROM range(5, 1000) r WHERE r.range NOT IN (SELECT cell_id FROM k) UNION ALL SELECT cell_id, 'extra' FROM k WHERE cell_id NOT BETWEEN 5 AND 999")
def missing_extra(spark, d):
    kept = T.read(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("cell_id"))
    return sinks.missing_and_extra(kept, 5, 999)


@register("bulk_write_ids", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS cell_id, s_suppkey FROM supplier")
def bulk_write_ids(spark, d):
    return R.dense_ids(T.read(spark, d, "supplier", "s_suppkey"), "s_suppkey", "cell_id").select("cell_id", "s_suppkey")


@register("common_variables", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier")
def common_variables(spark, d):
    return T.read(spark, d, "lineitem", "l_suppkey").select(F.col("l_suppkey").alias("k")).intersect(T.read(spark, d, "supplier", "s_suppkey"))


XNP, YNP = 6, 3


def quads(raster):
    """Raster nodes with their two triangles: the lattice's quads are split along one diagonal, so 2q and 2q + 1 share quad q."""
    qi, qj = F.floor(F.col("i") * (XNP - 1) / 50.0), F.floor(F.col("j") * (YNP - 1) / 11.0)
    x, y = F.col("i") * (XNP - 1) / 50.0 - qi, F.col("j") * (YNP - 1) / 11.0 - qj
    quad = (qi * (YNP - 1) + qj).cast("int")
    return raster.withColumn("quad", quad).withColumn("tri_id", (quad * 2 + (x + y > 1.0).cast("int")).cast("int"))


_QUADS = f"q AS (SELECT *, CAST(floor(i * {XNP - 1} / 50.0) * {YNP - 1} + floor(j * {YNP - 1} / 11.0) AS INT) AS quad, CAST(i * {XNP - 1} / 50.0 - floor(i * {XNP - 1} / 50.0) + (j * {YNP - 1} / 11.0 - floor(j * {YNP - 1} / 11.0)) > 1.0 AS INT) AS half FROM raster), t AS (SELECT *, quad * 2 + half AS tri_id FROM q)"


@register("quad_split", f"WITH {RASTER}, {_QUADS} SELECT tri_id, count(*) AS n, {rnd('avg(i)')} AS ci, {rnd('avg(j)')} AS cj FROM t GROUP BY 1")
def quad_split(spark, d):
    return rounded(quads(T.raster(spark, d)).groupBy("tri_id").agg(F.count("*").alias("n"), F.avg("i").alias("ci"), F.avg("j").alias("cj")))


@register("land_triangles_even", f"WITH {RASTER}, {_QUADS}, m AS (SELECT avg(z) AS m FROM raster) SELECT tri_id, {rnd('avg(CASE WHEN z - m <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS low_share, CAST(avg(CASE WHEN z - m <= 0.5 THEN 1.0 ELSE 0.0 END) <= 0.95 AS INT) AS is_land FROM t, m WHERE tri_id % 2 = 0 GROUP BY 1")
def land_triangles_even(spark, d):
    z = T.raster(spark, d)
    z = z.crossJoin(F.broadcast(z.agg(F.avg("z").alias("m")))).withColumn("z", F.col("z") - F.col("m"))
    return rounded(R.land_flags(quads(z).where("tri_id % 2 = 0"), ("tri_id",)))


@register("pair_errors", f"WITH {RASTER}, {_QUADS}, s AS (SELECT quad, tri_id, avg(z) AS v FROM t GROUP BY 1, 2), p AS (SELECT quad, sum(v) / count(*) AS fa, (SELECT avg(z) FROM t u WHERE u.quad = s.quad) AS ref FROM s GROUP BY 1) SELECT s.tri_id, {rnd('(fa / ref - 1) * 100', 5)} AS rel_err FROM s JOIN p USING (quad)")
def pair_errors(spark, d):
    """Errors of triangle pairs against their quad, given to both triangles."""
    t = quads(T.raster(spark, d))
    s = t.groupBy("quad", "tri_id").agg(F.avg("z").alias("v"))
    p = s.groupBy("quad").agg(F.avg("v").alias("fa")).join(t.groupBy("quad").agg(F.avg("z").alias("ref")), "quad")
    return rounded(s.join(p, "quad").select("tri_id", ((F.col("fa") / F.col("ref") - 1) * 100).alias("rel_err")), 5)


_SPARSE = "SELECT p_size, p_brand, avg(p_retailprice) AS z FROM part GROUP BY 1, 2"


@register("sparse_raster_fill", f"WITH s AS ({_SPARSE}), a AS (SELECT DISTINCT p_size FROM part), b AS (SELECT DISTINCT p_brand FROM part) SELECT p_size, p_brand, {rnd('coalesce(z, 0.0)', 4)} AS z FROM a CROSS JOIN b LEFT JOIN s USING (p_size, p_brand)")
def sparse_raster_fill(spark, d):
    """A raster assembled on the product of its axes (which are small), 0 where no point lies."""
    from ..operators.joins import scattered

    part = T.read(spark, d, "part", "p_size", "p_brand", "p_retailprice")
    nodes = part.select("p_size").distinct().crossJoin(part.select("p_brand").distinct())
    return rounded(scattered(nodes, part.groupBy("p_size", "p_brand").agg(F.avg("p_retailprice").alias("z")), ["p_size", "p_brand"], "z"), 4)


@register("bbox_expand", "WITH c AS (SELECT s_suppkey AS cell_id, s_nationkey * 7.0 - 84.0 AS lat FROM supplier) SELECT cell_id, round(CASE WHEN lat - 1 - 1.5 < -90 THEN lat - 1 - 1.5 + 1.5 ELSE lat - 1 - 1.5 END + 1.7e-8, 5) + 0.0 AS south, round(CASE WHEN lat + 1 + 1.5 > 90 THEN lat + 1 + 1.5 - 1.5 ELSE lat + 1 + 1.5 END + 1.7e-8, 5) + 0.0 AS north FROM c")
def bbox_expand(spark, d):
    lat = F.col("lat")
    v = T.mesh_cells(spark, d).withColumn("v", geo.expand_extremes(F.array(lat - 1, lat, lat + 1), 1.5, False, 1.5))
    return rounded(v.select("cell_id", F.col("v")[0].alias("south"), F.col("v")[2].alias("north")), 5)


@register("hourly_normal_sums", """
SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n, round(sum(value) + 1.7e-8, 3) + 0.0 AS z, round(sum(value * cos(2 * pi() * epoch(ts) / 86400.0)) + 1.7e-8, 3) + 0.0 AS zc, round(sum(value * sin(2 * pi() * epoch(ts) / 86400.0)) + 1.7e-8, 3) + 0.0 AS zs FROM events GROUP BY 1""")
def hourly_normal_sums(spark, d):
    """The additive sums of a daily one-mode fit: what the streaming fit keeps as state."""
    from ..streaming.incremental import normal_sums

    events = T.read(spark, d, "events", "ts", "value")
    sums = normal_sums(events.withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")), ["day"])
    return rounded(sums.select("day", "n", "z", "zc", "zs"), 3)


@register("strict_merge_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE c_nationkey % 2 = 1) AS n_land, count(*) FILTER (WHERE c_nationkey % 2 = 0) AS n_ocean FROM customer")
def strict_merge_counts(spark, d):
    """Chunks with and without a column, merged by name; every id is there once, or the merge raises an error."""
    c = T.read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(F.col("c_custkey").alias("cell_id"), (F.col("c_nationkey") % 2).alias("is_land"), "c_acctbal")
    first, last = c.agg(F.coalesce(F.min("cell_id"), F.lit(0)), F.coalesce(F.max("cell_id"), F.lit(-1))).head()
    parts = c.where("cell_id % 2 = 0").drop("c_acctbal").unionByName(c.where("cell_id % 2 = 1"), allowMissingColumns=True)
    return sinks.cover_counts(sinks.merged_strictly(parts, first, last))


@register("field_digest", f"WITH {CELLS} SELECT cell_id, sha256(string_agg(printf('%.3f', round(z, 3) + 0.0), ',' ORDER BY i, j)) AS digest FROM cells GROUP BY 1")
def field_digest(spark, d):
    """A digest of each cell's field."""
    return sinks.digest(T.cells_raster(spark, d))
