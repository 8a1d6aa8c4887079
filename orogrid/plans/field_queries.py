"""Records, crops, regridding, batches, supports and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics, lsff, modes, sinks
from ..operators import raster as R
from ..sources import fields
from ..sources import tables as T
from ..sources.tables import NI, NJ
from .base import CELLS, CENTRES, RASTER, register, rnd, rounded
from .spectral_queries import _P, _TOP, _WAVE, FIT, NHI, NHJ, TOP, demeaned, fit, flux_sql, wave

_RECORDS = f"{CELLS}, n AS (SELECT cell_id, i * 0.5 + cell_id * 12.0 AS lat, j * 1.0 AS lon, z FROM cells)"


@register("multi_record_scan", f"WITH {_RECORDS} SELECT lat, lon, {rnd('arg_min(z, cell_id)')} AS z FROM n WHERE lat BETWEEN 5.0 - 2 * 0.5 AND 30.0 + 2 * 0.5 AND lon BETWEEN 2.0 - 2 AND 7.0 + 2 GROUP BY 1, 2")
def multi_record_scan(spark, d):
    n = T.cells_raster(spark, d).select(F.col("cell_id").alias("record"), "i", "j", (F.col("i") * 0.5 + F.col("cell_id") * 12.0).alias("lat"), (F.col("j") * 1.0).alias("lon"), "z")
    return rounded(fields.multi_record_scan(fields.packed(n), (5.0, 30.0), (2.0, 7.0), 2))


@register("crop_and_downsample", f"WITH {RASTER}, b AS (SELECT i - 6 AS i, j - 1 AS j, CASE WHEN z < 37000 THEN -32767.0 ELSE z END AS z FROM raster WHERE i BETWEEN 6 AND 42 AND j BETWEEN 1 AND 9) SELECT i // 4 AS bi, j // 4 AS bj, {rnd('avg(z)', 5)} AS z FROM b GROUP BY 1, 2 HAVING count(*) = 16")
def crop_and_downsample(spark, d):
    return rounded(fields.crop_and_downsample(T.raster(spark, d), (6, 43), (1, 10), 4, -32767.0, F.col("z") < 37000), 5)


@register("regrid_linear", f"""
WITH {RASTER}, s AS (SELECT i, j * 1.3 AS x, z, lead(j * 1.3) OVER w AS x1, lead(z) OVER w AS z1 FROM raster WINDOW w AS (PARTITION BY i ORDER BY j)),
     k AS (SELECT s AS k FROM range(0, 40) t(s))
SELECT i, {rnd('k * 0.5')} AS lon, {rnd('CASE WHEN x1 IS NULL OR k * 0.5 = x THEN z ELSE z + (z1 - z) * (k * 0.5 - x) / (x1 - x) END', 5)} AS z FROM s JOIN k ON k * 0.5 >= x AND (k * 0.5 < x1 OR (x1 IS NULL AND k * 0.5 = x))""")
def regrid_linear(spark, d):
    return rounded(fields.regridded(T.raster(spark, d).select("i", (F.col("j") * F.lit(1.3)).alias("lon"), "z"), 0.5), 6, z=5)


@register("subset_renumber", "WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) SELECT c_custkey, c_acctbal, CAST(dense_rank() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS new_id FROM customer JOIN k ON c_custkey = o_custkey")
def subset_renumber(spark, d):
    wanted = T.read(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.dense_ids(T.read(spark, d, "customer", "c_custkey", "c_acctbal").join(wanted, "c_custkey", "left_semi"), "c_custkey")


_GB = "CASE WHEN abs(lat) < 60 THEN 10.0 WHEN abs(lat) >= 85 THEN 60.0 ELSE 10.0 * pow(1.0 / cos(radians(abs(lat))), 0.7) END"
_BATCHES = f"""{CENTRES}, o AS (SELECT cell_id, {_GB} AS gb, row_number() OVER (ORDER BY {_GB} DESC, cell_id) AS rn FROM centres),
     b AS (SELECT cell_id, gb, rn, 0 AS batch_id, 1 AS cnt, gb AS total FROM o WHERE rn = 1 UNION ALL
           SELECT o.cell_id, o.gb, o.rn, CASE WHEN (b.total + o.gb) / (cnt + 1) * cnt > 240.5 THEN batch_id + 1 ELSE batch_id END, CASE WHEN (b.total + o.gb) / (cnt + 1) * cnt > 240.5 THEN 1 ELSE cnt + 1 END,
                  CASE WHEN (b.total + o.gb) / (cnt + 1) * cnt > 240.5 THEN o.gb ELSE b.total + o.gb END FROM b JOIN o ON o.rn = b.rn + 1),
     w AS (SELECT batch_id, avg(gb) * 1.5 AS own, greatest(1, CAST(floor(240.5 / (avg(gb) * 1.5)) AS INT)) AS n_workers FROM b GROUP BY 1)"""


@register("memory_batches", f"WITH RECURSIVE {_BATCHES} SELECT cell_id, {rnd('gb')} AS gb, CAST(batch_id AS BIGINT) AS batch_id, n_workers, {rnd('CASE WHEN n_workers = 1 THEN least(own, 240.5) ELSE own END')} AS worker_gb FROM b JOIN w USING (batch_id)")
def memory_batches(spark, d):
    return rounded(fields.memory_batches(T.mesh_cells(spark, d), 240.5))


@register("batch_chunks", f"WITH RECURSIVE {_BATCHES}, c AS (SELECT DISTINCT l_suppkey AS cell_id, l_suppkey // 10 AS chunk FROM lineitem) SELECT CAST(batch_id AS BIGINT) AS batch_id, chunk, count(*) AS n FROM b JOIN c USING (cell_id) GROUP BY ALL")
def batch_chunks(spark, d):
    """The cells that are both in a memory batch and in a chunk of ids, counted."""
    chunks = T.read(spark, d, "lineitem", "l_suppkey").select(F.col("l_suppkey").alias("cell_id")).distinct().withColumn("chunk", F.expr("cell_id div 10"))
    batches = fields.memory_batches(T.mesh_cells(spark, d), 240.5)
    return batches.join(chunks, "cell_id").groupBy("batch_id", "chunk").agg(F.count("*").alias("n"))


@register("heaviest_cells", f"WITH {CENTRES} SELECT cell_id, {rnd('CASE WHEN abs(lat) < 60 THEN 10.0 WHEN abs(lat) >= 85 THEN 60.0 ELSE 10.0 * pow(1.0 / cos(radians(abs(lat))), 0.7) END')} AS gb FROM centres ORDER BY abs(lat) DESC, cell_id LIMIT 10")
def heaviest_cells(spark, d):
    from ..functions.geo import memory_gb

    return rounded(T.mesh_cells(spark, d).orderBy(F.desc(F.abs("lat")), "cell_id").limit(10).select("cell_id", memory_gb("lat").alias("gb")))


@register("recompute_support", f"WITH {FIT}, {_TOP} SELECT c.cell_id, i, j, {rnd(f'sum(CASE WHEN k_idx < {NHI // 2} THEN a_cos * cos{_P} + a_sin * sin{_P} ELSE 0 END)', 4)} AS recon FROM c JOIN top ON c.cell_id = top.cell_id AND rank <= {TOP} GROUP BY ALL")
def recompute_support(spark, d):
    """Stored amplitudes of the lower half of the wavenumbers on the full rectangle."""
    top = modes.top_modes(fit(spark, d), TOP)
    half = top.withColumn("a_cos", F.when(F.col("k_idx") < NHI // 2, F.col("a_cos")).otherwise(0.0)).withColumn("a_sin", F.when(F.col("k_idx") < NHI // 2, F.col("a_sin")).otherwise(0.0))
    return rounded(lsff.reconstruction(demeaned(spark, d), half, NI, NJ, ("cell_id",)).select("cell_id", "i", "j", "recon"), 4)


@register("spectrum_block_mean", f"WITH {FIT}, a AS (SELECT *, CASE WHEN m_i = 0 AND m_j = 0 THEN NULL ELSE ampl END AS a FROM ampl), w AS (SELECT *, {_WAVE} FROM a) SELECT cell_id, k_idx // 3 AS bk, l_idx // 3 AS bl, {rnd('avg(a)', 4)} AS ampl, {rnd('max(CASE WHEN k_idx % 3 = 1 AND l_idx % 3 = 1 THEN kk END)', 9)} AS kk, {rnd('max(CASE WHEN k_idx % 3 = 1 AND l_idx % 3 = 1 THEN ll END)', 9)} AS ll FROM w GROUP BY 1, 2, 3")
def spectrum_block_mean(spark, d):
    """Means of 3 x 3 blocks of a spectrum over the modes that exist, with every third wavenumber."""
    a = wave(fit(spark, d)).withColumn("ampl", F.when((F.col("m_i") == 0) & (F.col("m_j") == 0), None).otherwise(F.col("ampl")))
    return rounded(modes.coarse_spectrum(a), 9, ampl=4)


@register("modes_restricted", f"WITH {FIT}, {_TOP}, p AS (SELECT * FROM top WHERE rank <= 4), n AS (SELECT cell_id, max(k_idx) + 1 + (max(k_idx) + 1) % 2 AS nhi, max(l_idx) + 1 + (max(l_idx) + 1) % 2 AS nhj FROM p GROUP BY 1) SELECT cell_id, k_idx, l_idx, m_i, m_j, CAST(nhi AS INT) AS nhi, CAST(nhj AS INT) AS nhj FROM p JOIN n USING (cell_id)")
def modes_restricted(spark, d):
    """The modes of each cell's four strongest, with sizes recomputed from the largest index."""
    return modes.restricted(modes.mode_table(spark, NHI, NHJ), modes.top_modes(fit(spark, d), 4), recompute=True)


@register("mode_columns", f"""
WITH m AS (SELECT CAST(k AS INT) AS k_idx, CAST(l AS INT) AS l_idx, k AS m_i, l - {NHJ // 2 - 1} AS m_j FROM range({NHI}) a(k), range({NHJ}) b(l)),
     c AS (SELECT 'cos' AS part, * FROM m WHERE NOT (m_i = 0 AND m_j < 0) UNION ALL SELECT 'sin', * FROM m WHERE NOT (m_i = 0 AND m_j <= 0)), n AS (SELECT CAST(row_number() OVER (ORDER BY part, k_idx, l_idx) - 1 AS INT) AS col, part, k_idx, l_idx FROM c),
     w AS (SELECT DISTINCT l_partkey % {2 * NHI * NHJ - NHJ + 1} AS col FROM lineitem) SELECT n.col, part, k_idx, l_idx FROM n JOIN w ON n.col = w.col""")
def mode_columns(spark, d):
    """The modes of given basis columns, by a join on the column number."""
    table = modes.basis_columns(modes.mode_table(spark, NHI, NHJ))
    wanted = T.read(spark, d, "lineitem", "l_partkey").select((F.col("l_partkey") % table.count()).cast("int").alias("col")).distinct()
    return table.join(wanted, "col").select("col", "part", "k_idx", "l_idx")


@register("variant_comparison", f"""
WITH {CELLS}, c AS (SELECT cell_id, i, j, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM cells), v AS (SELECT * FROM (VALUES (0, 5), (1, 10), (2, 20)) t(variant, n_modes)),
 {FIT[FIT.index('modes AS ('):]}, {_TOP},
 r AS (SELECT variant, c.cell_id, i, j, z, sum(a_cos * cos{_P} + a_sin * sin{_P}) AS recon FROM v JOIN top ON rank <= n_modes JOIN c ON c.cell_id = top.cell_id GROUP BY ALL)
SELECT variant, cell_id, {rnd('sqrt(avg(pow(z - recon, 2)))', 4)} AS rmse FROM r GROUP BY 1, 2""")
def variant_comparison(spark, d):
    """The error of several settings of one pipeline: variants are rows, broadcast to the spectra."""
    variants = spark.createDataFrame([(0, 5), (1, 10), (2, 20)], "variant int, n_modes int")
    top = modes.top_modes(fit(spark, d), 20).join(F.broadcast(variants), F.col("rank") <= F.col("n_modes"))
    z = demeaned(spark, d).crossJoin(F.broadcast(variants.select("variant")))
    recon = lsff.reconstruction(z, top, NI, NJ, ("variant", "cell_id"))
    return rounded(diagnostics.rmse(recon, ("variant", "cell_id")).select("variant", "cell_id", "rmse"), 4)


_VARIANTS = "v AS (SELECT * FROM (VALUES (0, 5), (1, 10), (2, 20)) t(variant, n_modes))"


@register("variant_improvements", f"""
WITH {CELLS}, c AS (SELECT cell_id, i, j, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM cells), {_VARIANTS},
 {FIT[FIT.index('modes AS ('):]}, {_TOP}, f AS (SELECT *, {_WAVE} FROM top WHERE rank <= 20), u AS (SELECT cell_id, k_idx, l_idx, rank, {flux_sql()} AS uw FROM f),
 r AS (SELECT variant, c.cell_id, i, j, z, sum(a_cos * cos{_P} + a_sin * sin{_P}) AS recon FROM v JOIN top ON rank <= n_modes JOIN c ON c.cell_id = top.cell_id GROUP BY ALL),
 e AS (SELECT variant, cell_id, sqrt(avg(pow(z - recon, 2))) AS rmse FROM r GROUP BY 1, 2),
 d AS (SELECT variant, cell_id, max(abs(CASE WHEN rank <= n_modes THEN uw ELSE 0 END - CASE WHEN rank <= 5 THEN uw ELSE 0 END)) / max(abs(CASE WHEN rank <= 5 THEN uw ELSE 0 END)) AS rel_diff FROM u, v WHERE variant > 0 GROUP BY 1, 2)
SELECT e.variant, e.cell_id, {rnd('rel_diff', 4)} AS rel_diff, {rnd('(b.rmse - e.rmse) / b.rmse * 100', 4)} AS improvement FROM e JOIN e b ON b.cell_id = e.cell_id AND b.variant = 0 JOIN d ON d.variant = e.variant AND d.cell_id = e.cell_id""")
def variant_improvements(spark, d):
    """How far each setting's fluxes and errors are from those of the first one."""
    from ..functions.spectral import flux

    variants = spark.createDataFrame([(0, 5), (1, 10), (2, 20)], "variant int, n_modes int")
    every = modes.top_modes(fit(spark, d), 20).crossJoin(F.broadcast(variants))
    own = every.where(F.col("rank") <= F.col("n_modes"))
    recon = lsff.reconstruction(demeaned(spark, d).crossJoin(F.broadcast(variants.select("variant"))), own, NI, NJ, ("variant", "cell_id"))
    better = diagnostics.improvements(diagnostics.rmse(recon, ("variant", "cell_id")), "rmse", 0)
    uw = wave(every).withColumn("uw", F.when(F.col("rank") <= F.col("n_modes"), flux("ampl", "kk", "ll", 10.0, 0.0)).otherwise(0.0))
    return rounded(diagnostics.flux_differences(uw, "uw", 0, ("k_idx", "l_idx")).join(better, ["variant", "cell_id"]), 4)


@register("result_scan", f"SELECT o_orderkey AS cell_id, {rnd('o_custkey / 7.0', 4)} AS lat, {rnd('o_custkey / 3.0', 4)} AS lon, {rnd('o_totalprice', 4)} AS data, {rnd('o_totalprice / 2', 4)} AS spec, {rnd('o_totalprice / 4', 4)} AS pmf FROM orders")
def result_scan(spark, d):
    """All records read back chunk by chunk from a written, chunk-partitioned table, with the reader's names."""
    from ..session import shared_path

    path = shared_path(spark, "results")
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    rows = T.read(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey").select(F.col("o_orderkey").alias("cell_id"), (cust / 7.0).alias("lat"), (cust / 3.0).alias("lon"), price.alias("recon"), (price / 2).alias("ampls"), (price / 4).alias("pmf_sg"))
    return rounded(sinks.read_results(spark.read.parquet(sinks.write_chunks(rows, path, nulls=True))), 4)


_RANGE = "r AS (SELECT max(o_orderkey) // 4 AS lo, max(o_orderkey) // 2 AS hi, min(o_orderkey) AS one FROM orders)"


@register("record_range", f"WITH {_RANGE} SELECT o_orderkey AS cell_id, {rnd('o_totalprice', 4)} AS data, o_orderkey = one AS single FROM orders, r WHERE o_orderkey >= lo AND o_orderkey < hi OR o_orderkey = one")
def record_range(spark, d):
    """The second quarter of the ids, and one cell alone, read back from chunked results whose other chunks are not opened."""
    from ..session import shared_path

    rows = T.read(spark, d, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("cell_id"), F.col("o_totalprice").alias("recon"))
    path = sinks.write_chunks(rows, shared_path(spark, "chunks"))
    ends = rows.agg(F.min("cell_id").alias("one"), F.max("cell_id").alias("top")).head()
    part = sinks.read_range(spark, path, ends["top"] // 4, ends["top"] // 2).where(F.col("cell_id") != ends["one"])
    both = part.withColumn("single", F.lit(False)).unionByName(sinks.read_range(spark, path, ends["one"], ends["one"] + 1).withColumn("single", F.lit(True)))
    return rounded(sinks.read_results(both).join(both.select("cell_id", "single"), "cell_id"), 4)
