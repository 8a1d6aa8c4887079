"""Spectral fits, selection, fluxes and errors as DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.spectral import flux, prior_weight
from ..operators import diagnostics, lsff, modes
from ..operators import raster as R
from ..sources import tables as T
from ..sources.tables import NI, NJ
from .base import CELLS, RASTER, SERIES, register, rnd, rounded
from .raster_queries import IN_TRIANGLE, inside_triangle

NHI, NHJ, LAM, TOP, METRES = 12, 10, 0.1, 10, 1000.0
COLUMNS = 2 * NHI * NHJ - NHJ + 1
SHARE = (1 + 0.5 * (COLUMNS - 1)) / COLUMNS

MODES = f"modes AS (SELECT CAST(k AS INT) AS k_idx, CAST(l AS INT) AS l_idx, CAST(k AS INT) AS m_i, CAST(l - {NHJ // 2 - 1} AS INT) AS m_j FROM range({NHI}) a(k), range({NHJ}) b(l))"
DEMEANED = f"{CELLS}, c AS (SELECT cell_id, i, j, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM cells)"
_P = f"(2 * pi() * (m_i * i / {NI}.0 + m_j * j / {NJ}.0))"


def _spectra(lam: float, source: str = "c", key: str = "cell_id, ") -> str:
    pen = f"{lam} * {SHARE!r} * n"
    return f"""sums AS (SELECT {key}k_idx, l_idx, m_i, m_j, sum(z * cos{_P}) AS cs, sum(z * sin{_P}) AS sn, count(*) AS n FROM {source}, modes GROUP BY ALL),
 spectra AS (SELECT {key}k_idx, l_idx, m_i, m_j, CASE WHEN m_i = 0 AND m_j < 0 THEN 0 ELSE cs / (CASE WHEN m_i = 0 AND m_j = 0 THEN n ELSE n / 2.0 END + {pen}) END AS a_cos,
   CASE WHEN m_i = 0 AND m_j <= 0 THEN 0 ELSE sn / (n / 2.0 + {pen}) END AS a_sin FROM sums),
 ampl AS (SELECT *, sqrt(a_cos * a_cos + a_sin * a_sin) AS ampl FROM spectra WHERE NOT (m_i = 0 AND m_j < 0))"""


FIT = f"{DEMEANED}, {MODES}, {_spectra(LAM)}"
_TOP = f"top AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ampl DESC, l_idx, k_idx) AS rank FROM ampl)"


def wave(df):
    """Physical wavenumbers of the modes on a lattice of kilometre spacing."""
    return df.withColumn("kk", F.lit(2 * math.pi) * F.col("m_i") / (NI * METRES)).withColumn("ll", F.lit(2 * math.pi) * F.col("m_j") / (NJ * METRES))


_WAVE = f"2 * pi() * m_i / {NI * METRES} AS kk, 2 * pi() * m_j / {NJ * METRES} AS ll"


def flux_sql(u: str = "10.0", v: str = "0.0", ampl: str = "ampl") -> str:
    om, kk = f"(-kk * {u} - ll * {v})", "(kk * kk + ll * ll)"
    m = f"(CASE WHEN {om} <> 0 THEN sqrt(greatest(0.0004 * {kk} / ({om} * {om}) - {kk}, 0.0)) ELSE 0.0 END)"
    return f"(CASE WHEN {om} <> 0 AND {kk} > 0 THEN -0.5 * {ampl} * {ampl} * 0.0004 / {om} * kk * 0.02 * sqrt({kk}) * {m} / (({kk} + {m} * {m}) * sqrt({kk} + {m} * {m})) ELSE 0.0 END)"


def columns(spark):
    return modes.basis_columns(modes.mode_table(spark, NHI, NHJ))


def demeaned(spark, d):
    return R.demeaned(T.cells_raster(spark, d))


def fit(spark, d, lam: float = LAM):
    """(cell_id, modes, a_cos, a_sin, ampl) of every cell on its full rectangle."""
    return lsff.spectrum(lsff.rectangle_fit(demeaned(spark, d), columns(spark), NI, NJ, lam, ("cell_id",)), ("cell_id",))


@register("modes_table", f"WITH {CELLS}, {MODES} SELECT cell_id, k_idx, l_idx, m_i, m_j FROM (SELECT DISTINCT cell_id FROM cells), modes")
def modes_table(spark, d):
    """The modes that each cell of the raster is fitted with."""
    return T.cells_raster(spark, d).select("cell_id").distinct().crossJoin(F.broadcast(modes.mode_table(spark, NHI, NHJ)))


@register("lsff_rhs", f"WITH {DEMEANED}, {MODES} SELECT cell_id, k_idx, l_idx, 'cos' AS part, {rnd(f'sum(z * cos{_P})', 3)} AS rhs FROM c, modes WHERE NOT (m_i = 0 AND m_j < 0) GROUP BY ALL UNION ALL SELECT cell_id, k_idx, l_idx, 'sin', {rnd(f'sum(z * sin{_P})', 3)} FROM c, modes WHERE NOT (m_i = 0 AND m_j <= 0) GROUP BY ALL")
def lsff_rhs(spark, d):
    return rounded(lsff.right_hand_side(demeaned(spark, d), columns(spark), NI, NJ, ("cell_id",)).select("cell_id", "k_idx", "l_idx", "part", "rhs"), 3)


SMALL = "small AS (SELECT CAST(row_number() OVER (ORDER BY part, m_i, m_j) - 1 AS INT) AS col, part, m_i, m_j FROM (VALUES ('cos', 0, 0), ('cos', 1, 0), ('cos', 1, 1), ('sin', 1, 0), ('sin', 1, 1), ('sin', 0, 1), ('cos', 0, 1)) t(part, m_i, m_j))"
_B = "(CASE WHEN {0}.part = 'cos' THEN cos(2 * pi() * ({0}.m_i * i / 50.0 + {0}.m_j * j / 11.0)) ELSE sin(2 * pi() * ({0}.m_i * i / 50.0 + {0}.m_j * j / 11.0)) END)"


def small_columns(spark):
    return modes.basis_columns(modes.mode_table(spark, 2, 2).select("k_idx", F.col("l_idx"), "m_i", "m_j"))


def triangle_points(spark, d):
    return inside_triangle(demeaned(spark, d)).where("inside").select("cell_id", "i", "j", "z")


TRI = f"{DEMEANED}, p AS (SELECT *, i / 49.0 AS x, j / 10.0 AS y FROM c), tri AS (SELECT cell_id, i, j, z FROM p WHERE {IN_TRIANGLE})"


@register("lsff_gram_small", f"WITH {TRI}, {SMALL} SELECT cell_id, a.col, b.col AS col2, {rnd(f'sum({_B.format("a")} * {_B.format("b")})', 5)} AS g FROM tri, small a, small b WHERE a.col <= b.col GROUP BY ALL")
def lsff_gram_small(spark, d):
    return rounded(lsff.gram(triangle_points(spark, d), small_columns(spark), NI, NJ, ("cell_id",)), 5)


@register("lsff_trace", f"WITH {TRI}, {SMALL} SELECT cell_id, {rnd(f'sum({_B.format("small")} * {_B.format("small")})', 5)} AS trace, {rnd(f'sum({_B.format("small")} * {_B.format("small")}) / count(DISTINCT col)', 5)} AS mean_diagonal FROM tri, small GROUP BY 1")
def lsff_trace(spark, d):
    g = lsff.gram(triangle_points(spark, d), small_columns(spark), NI, NJ, ("cell_id",)).where("col = col2")
    return rounded(g.groupBy("cell_id").agg(F.sum("g").alias("trace"), F.avg("g").alias("mean_diagonal")), 5)


for _name, _lam in (("lsff_rect_full", LAM), ("lsff_rect_exact", 0.0)):

    @register(_name, f"WITH {DEMEANED}, {MODES}, {_spectra(_lam)} SELECT cell_id, k_idx, l_idx, {rnd('a_cos', 4)} AS a_cos, {rnd('a_sin', 4)} AS a_sin, {rnd('ampl', 4)} AS ampl FROM ampl")
    def _rect(spark, d, lam=_lam):
        return rounded(fit(spark, d, lam).select("cell_id", "k_idx", "l_idx", "a_cos", "a_sin", "ampl"), 4)


@register("lsff_two_mode_triangle", f"""
WITH {TRI}, s AS (SELECT cell_id, i, j, z, cos(2 * pi() * i / 50.0) AS u, sin(2 * pi() * j / 11.0) AS v FROM tri),
     g AS (SELECT cell_id, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * z) AS uz, sum(v * z) AS vz FROM s GROUP BY 1)
SELECT cell_id, {rnd('(uz * vv - vz * uv) / (uu * vv - uv * uv)', 4)} AS a_u, {rnd('(vz * uu - uz * uv) / (uu * vv - uv * uv)', 4)} AS a_v FROM g""")
def lsff_two_mode_triangle(spark, d):
    s = triangle_points(spark, d).withColumn("u", F.cos(2 * math.pi * F.col("i") / 50.0)).withColumn("v", F.sin(2 * math.pi * F.col("j") / 11.0))
    g = s.groupBy("cell_id").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("uu", "uv", "vv", "uz", "vz")])
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    return rounded(g.select("cell_id", ((F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / det).alias("a_u"), ((F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / det).alias("a_v")), 4)


@register("dft2_amplitude", f"WITH {DEMEANED}, {MODES} SELECT cell_id, k_idx, l_idx, {rnd(f'sqrt(pow(sum(z * cos{_P}), 2) + pow(sum(z * sin{_P}), 2)) / (count(*) / 2.0)', 4)} AS ampl FROM c, modes GROUP BY ALL")
def dft2_amplitude(spark, d):
    return rounded(lsff.periodogram(demeaned(spark, d), modes.mode_table(spark, NHI, NHJ), NI, NJ, ("cell_id",)).select("cell_id", "k_idx", "l_idx", "ampl"), 4)


@register("dft1_series", f"WITH {SERIES}, s AS (SELECT t, z - (SELECT avg(z) FROM series) AS z FROM series), f AS (SELECT CAST(k AS INT) AS k_idx FROM range(1, 25) t(k)) SELECT k_idx, {rnd('sqrt(pow(sum(z * cos(2 * pi() * k_idx * t / 720.0)), 2) + pow(sum(z * sin(2 * pi() * k_idx * t / 720.0)), 2)) / (count(*) / 2.0)', 4)} AS ampl FROM s, f GROUP BY 1")
def dft1_series(spark, d):
    s = T.series(spark, d)
    s = s.crossJoin(F.broadcast(s.agg(F.avg("z").alias("m")))).select("t", (F.col("z") - F.col("m")).alias("z"))
    f = spark.range(1, 25).select(F.col("id").cast("int").alias("k_idx"))
    p = 2 * math.pi * F.col("k_idx") * F.col("t") / 720.0
    sums = s.crossJoin(F.broadcast(f)).groupBy("k_idx").agg(F.sum(F.col("z") * F.cos(p)).alias("re"), F.sum(F.col("z") * F.sin(p)).alias("im"), F.count("*").alias("n"))
    return rounded(sums.select("k_idx", (F.sqrt(F.pow("re", 2) + F.pow("im", 2)) / (F.col("n") / 2.0)).alias("ampl")), 4)


@register("topk_modes", f"WITH {FIT}, {_TOP} SELECT cell_id, k_idx, l_idx, CAST(rank AS INT) AS rank, {rnd('ampl', 4)} AS ampl FROM top WHERE rank <= {TOP}")
def topk_modes(spark, d):
    return rounded(modes.top_modes(fit(spark, d), TOP).select("cell_id", "k_idx", "l_idx", "rank", "ampl"), 4)


@register("topk_threshold_ties", f"WITH {FIT}, r AS (SELECT *, rank() OVER (PARTITION BY cell_id ORDER BY round(ampl) DESC) AS rank FROM ampl) SELECT cell_id, k_idx, l_idx, CAST(rank AS INT) AS rank, round(ampl) AS ampl FROM r WHERE rank <= {TOP}")
def topk_threshold_ties(spark, d):
    return modes.top_with_ties(fit(spark, d).withColumn("ampl", F.round("ampl")), TOP).select("cell_id", "k_idx", "l_idx", "rank", "ampl")


@register("distinct_pad_modes", f"""
WITH {FIT}, {_TOP}, q AS (SELECT cell_id, k_idx, l_idx, rank, CASE WHEN rank <= 6 THEN 0 ELSE 1 END AS src FROM top WHERE rank <= 6 OR k_idx < 3),
     o AS (SELECT cell_id, k_idx, l_idx, row_number() OVER (PARTITION BY cell_id ORDER BY src, rank) AS rank FROM q)
SELECT cell_id, k_idx, l_idx, CAST(rank AS INT) AS rank FROM o WHERE rank <= 12""")
def distinct_pad_modes(spark, d):
    ranked = modes.top_modes(fit(spark, d), NHI * NHJ)
    return modes.distinct_padded(ranked.where("rank <= 6"), ranked.where("k_idx < 3"), 12).select("cell_id", "k_idx", "l_idx", "rank")


RECON = f"{FIT}, {_TOP}, recon AS (SELECT c.cell_id, i, j, z, sum(a_cos * cos{_P} + a_sin * sin{_P}) AS recon FROM c JOIN top ON c.cell_id = top.cell_id AND rank <= {TOP} GROUP BY ALL)"


def reconstructed(spark, d):
    return lsff.reconstruction(demeaned(spark, d), modes.top_modes(fit(spark, d), TOP), NI, NJ, ("cell_id",))


@register("reconstruct", f"WITH {RECON} SELECT cell_id, i, j, {rnd('recon', 4)} AS recon FROM recon")
def reconstruct(spark, d):
    return rounded(reconstructed(spark, d).select("cell_id", "i", "j", "recon"), 4)


@register("reconstruct_scatter", f"WITH {RECON}, p AS (SELECT *, i / 49.0 AS x, j / 10.0 AS y FROM recon) SELECT cell_id, i, j, {rnd(f'CASE WHEN {IN_TRIANGLE} THEN recon ELSE 0 END', 4)} AS recon FROM p")
def reconstruct_scatter(spark, d):
    r = inside_triangle(reconstructed(spark, d))
    return rounded(r.select("cell_id", "i", "j", F.when(F.col("inside"), F.col("recon")).otherwise(0.0).alias("recon")), 4)


@register("rmse_rel", f"WITH {RECON}, s AS (SELECT cell_id, sqrt(avg(pow(z - recon, 2))) AS rmse, CASE WHEN max(z) <= 0 THEN 100.0 ELSE max(z) END AS top FROM recon GROUP BY 1) SELECT cell_id, {rnd('rmse', 5)} AS rmse, {rnd('rmse / (top + 200.0) * 100', 5)} AS rel_rmse FROM s")
def rmse_rel(spark, d):
    return rounded(diagnostics.rmse(reconstructed(spark, d)), 5)


def fluxes(spark, d, u=10.0, v=0.0):
    return wave(modes.top_modes(fit(spark, d), TOP)).withColumn("uw", flux("ampl", "kk", "ll", u, v))


@register("flux_modes", f"WITH {FIT}, {_TOP}, w AS (SELECT *, {_WAVE} FROM top WHERE rank <= {TOP}) SELECT cell_id, k_idx, l_idx, {rnd(flux_sql(), 4)} AS uw FROM w")
def flux_modes(spark, d):
    return rounded(fluxes(spark, d).select("cell_id", "k_idx", "l_idx", "uw"), 4)


@register("flux_total", f"WITH {FIT}, {_TOP}, w AS (SELECT *, {_WAVE} FROM top WHERE rank <= {TOP}) SELECT cell_id, {rnd(f'sum({flux_sql()})', 4)} AS uw FROM w GROUP BY 1")
def flux_total(spark, d):
    return rounded(fluxes(spark, d).groupBy("cell_id").agg(F.sum("uw").alias("uw")), 4)


@register("flux_pair_spectrum_sum", f"WITH {FIT}, s AS (SELECT cell_id // 2 AS pair, k_idx, l_idx, m_i, m_j, sum(ampl) AS ampl FROM ampl GROUP BY ALL), w AS (SELECT *, {_WAVE} FROM s) SELECT pair, {rnd(f'0.5 * sum({flux_sql()})', 3)} AS uw FROM w GROUP BY 1")
def flux_pair_spectrum_sum(spark, d):
    s = fit(spark, d).groupBy(F.expr("cast(cell_id div 2 as int)").alias("pair"), "k_idx", "l_idx", "m_i", "m_j").agg(F.sum("ampl").alias("ampl"))
    return rounded(wave(s).groupBy("pair").agg((0.5 * F.sum(flux("ampl", "kk", "ll", 10.0, 0.0))).alias("uw")), 3)


WINDS = [(-40.0, 20.0), *((round(10 * math.cos(a * math.pi / 4), 6), round(10 * math.sin(a * math.pi / 4), 6)) for a in range(8))]
_WINDS = "winds AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, CAST({u} AS DOUBLE), CAST({v} AS DOUBLE))" for n, (u, v) in enumerate(WINDS)) + ") t(wind, u, v))"


@register("wind_direction_sweep", f"WITH {FIT}, {_TOP}, {_WINDS}, w AS (SELECT *, {_WAVE} FROM top, winds WHERE rank <= {TOP}) SELECT cell_id, wind, {rnd(f'sum({flux_sql("u", "v")})', 3)} AS uw FROM w GROUP BY 1, 2")
def wind_direction_sweep(spark, d):
    winds = spark.createDataFrame([(n, u, v) for n, (u, v) in enumerate(WINDS)], "wind int, u double, v double")
    w = wave(modes.top_modes(fit(spark, d), TOP)).crossJoin(F.broadcast(winds))
    return rounded(w.groupBy("cell_id", "wind").agg(F.sum(flux("ampl", "kk", "ll", F.col("u"), F.col("v"))).alias("uw")), 3)


@register("spectral_slope", f"""
WITH {DEMEANED}, {MODES}, q AS (SELECT cell_id, m_i, m_j, (pow(sum(z * cos{_P}), 2) + pow(sum(z * sin{_P}), 2)) / pow(count(*) / 2.0, 2) AS power FROM c, modes GROUP BY ALL),
     b AS (SELECT cell_id, ln(sqrt(pow(m_i / 50.0, 2) + pow(m_j / 11.0, 2))) AS lk, ln(power) AS lp FROM q WHERE sqrt(pow(m_i / 50.0, 2) + pow(m_j / 11.0, 2)) BETWEEN 0.02 AND 0.5 AND power > 0),
     e AS (SELECT cell_id, min(lk) AS lo, max(lk) AS hi FROM b GROUP BY 1),
     m AS (SELECT cell_id, least(floor((lk - lo) / ((hi - lo) / 8)), 7) AS bin, avg(lk) AS x, avg(lp) AS y FROM b JOIN e USING (cell_id) GROUP BY 1, 2)
SELECT cell_id, {rnd('-regr_slope(y, x)', 5)} AS alpha, {rnd('sqrt(greatest((1 - regr_r2(y, x)) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2), 0.0))', 5)} AS stderr, {rnd('regr_r2(y, x)', 5)} AS r2, count(*) AS n_bins FROM m GROUP BY 1""")
def spectral_slope(spark, d):
    p = lsff.periodogram(demeaned(spark, d), modes.mode_table(spark, NHI, NHJ), NI, NJ, ("cell_id",))
    p = p.withColumn("kmag", F.sqrt(F.pow(F.col("m_i") / 50.0, 2) + F.pow(F.col("m_j") / 11.0, 2))).withColumn("power", F.col("ampl") * F.col("ampl"))
    return rounded(diagnostics.radial_slope(p, 8, keys=("cell_id",)), 5)


@register("prior_weights", f"WITH {FIT}, {_TOP}, k AS (SELECT *, sqrt(m_i * m_i + m_j * m_j) AS k FROM top WHERE rank <= {TOP}) SELECT cell_id, k_idx, l_idx, {rnd('pow(k / max(k) OVER (PARTITION BY cell_id) + 0.001, 1.5)')} AS w FROM k")
def prior_weights(spark, d):
    """The spectral prior's weights of each cell's strongest modes, by the largest wavenumber among them."""
    m = modes.top_modes(fit(spark, d), TOP)
    top = m.groupBy("cell_id").agg(F.max(F.hypot("m_i", "m_j")).alias("top"))
    return rounded(m.join(top, "cell_id").select("cell_id", "k_idx", "l_idx", prior_weight(F.col("m_i"), F.col("m_j"), F.col("top"), 1.5).alias("w")))


@register("gcv_lambda_rect", f"""
WITH {DEMEANED}, {MODES}, sums AS (SELECT cell_id, m_i, m_j, sum(z * cos{_P}) AS cs, sum(z * sin{_P}) AS sn, count(*) AS n, sum(z * z) AS zz FROM c, modes GROUP BY ALL),
     r AS (SELECT cell_id, n, zz, cs AS rhs, CASE WHEN m_i = 0 AND m_j = 0 THEN n ELSE n / 2.0 END AS dg FROM sums WHERE NOT (m_i = 0 AND m_j < 0) UNION ALL SELECT cell_id, n, zz, sn, n / 2.0 FROM sums WHERE NOT (m_i = 0 AND m_j <= 0)),
     g AS (SELECT CAST(s AS INT) AS step, pow(10.0, -6 + s * 0.25) AS lam FROM range(41) t(s)),
     x AS (SELECT cell_id, step, n, zz, dg / (dg + lam * {SHARE!r} * n) AS s, rhs, dg FROM r, g)
SELECT cell_id, step, {rnd('(max(zz) - sum((2 * s - s * s) * rhs * rhs / dg)) / pow(max(n) - sum(s), 2)', 3)} AS gcv FROM x GROUP BY 1, 2""")
def gcv_lambda_rect(spark, d):
    """The GCV score of every regularisation step; the diagonal Gram gives shrinkage, residual and trace in closed form."""
    z = demeaned(spark, d)
    rhs = lsff.right_hand_side(z, columns(spark), NI, NJ, ("cell_id",)).join(z.groupBy("cell_id").agg(F.sum(F.col("z") * F.col("z")).alias("zz")), "cell_id")
    rhs = rhs.withColumn("dg", F.when((F.col("m_i") == 0) & (F.col("m_j") == 0), F.col("n").cast("double")).otherwise(F.col("n") / 2.0))
    grid = spark.range(41).select(F.col("id").cast("int").alias("step"), F.pow(F.lit(10.0), -6 + F.col("id") * 0.25).alias("lam"))
    x = rhs.crossJoin(F.broadcast(grid)).withColumn("s", F.col("dg") / (F.col("dg") + F.col("lam") * SHARE * F.col("n")))
    left = F.max("zz") - F.sum((2 * F.col("s") - F.col("s") * F.col("s")) * F.col("rhs") * F.col("rhs") / F.col("dg"))
    return rounded(x.groupBy("cell_id", "step").agg((left / F.pow(F.max("n") - F.sum("s"), 2)).alias("gcv")), 3)


FOLDS_I, FOLDS_J, BUFFER = 4, 2, 2


@register("spatial_folds", f"WITH {RASTER} SELECT CAST(floor(i / (49.0 / {FOLDS_I})) * {FOLDS_J} + floor(j / (10.0 / {FOLDS_J})) AS INT) AS fold, count(*) AS n FROM raster WHERE i < 49 AND j < 10 GROUP BY 1")
def spatial_folds(spark, d):
    return folded(T.raster(spark, d)).groupBy("fold").agg(F.count("*").alias("n"))


def folded(points):
    """Points with their half-open spatial fold; points on the far edges are in none."""
    fold = F.floor(F.col("i") / (49.0 / FOLDS_I)) * FOLDS_J + F.floor(F.col("j") / (10.0 / FOLDS_J))
    return points.where("i < 49 and j < 10").withColumn("fold", fold.cast("int"))


@register("spatial_cv_constant", f"""
WITH {RASTER}, f AS (SELECT CAST(a * {FOLDS_J} + b AS INT) AS fold, a * 49.0 / {FOLDS_I} AS i0, (a + 1) * 49.0 / {FOLDS_I} AS i1, b * 10.0 / {FOLDS_J} AS j0, (b + 1) * 10.0 / {FOLDS_J} AS j1 FROM range({FOLDS_I}) t(a), range({FOLDS_J}) u(b)),
     x AS (SELECT fold, z, i >= i0 AND i < i1 AND j >= j0 AND j < j1 AS ev, NOT (i >= i0 - {BUFFER} AND i < i1 + {BUFFER} AND j >= j0 - {BUFFER} AND j < j1 + {BUFFER}) AS tr FROM raster, f),
     m AS (SELECT fold, avg(z) FILTER (WHERE tr) AS m, count(*) FILTER (WHERE tr) AS n_train FROM x GROUP BY 1)
SELECT fold, n_train, count(*) AS n_eval, {rnd('avg(pow(z - m, 2))', 3)} AS mse FROM x JOIN m USING (fold) WHERE ev GROUP BY ALL""")
def spatial_cv_constant(spark, d):
    f = spark.range(FOLDS_I * FOLDS_J).select(F.col("id").cast("int").alias("fold"), F.expr(f"id div {FOLDS_J}").alias("a"), (F.col("id") % FOLDS_J).alias("b"))
    wi, wj = F.lit(49.0) / FOLDS_I, F.lit(10.0) / FOLDS_J
    x = T.raster(spark, d).crossJoin(F.broadcast(f))
    inside = lambda pad: (F.col("i") >= F.col("a") * wi - pad) & (F.col("i") < (F.col("a") + 1) * wi + pad) & (F.col("j") >= F.col("b") * wj - pad) & (F.col("j") < (F.col("b") + 1) * wj + pad)
    x = x.withColumn("ev", inside(0)).withColumn("tr", ~inside(BUFFER))
    m = x.where("tr").groupBy("fold").agg(F.avg("z").alias("m"), F.count("*").alias("n_train"))
    return rounded(x.where("ev").join(m, "fold").groupBy("fold", "n_train").agg(F.count("*").alias("n_eval"), F.avg(F.pow(F.col("z") - F.col("m"), 2)).alias("mse")), 3)


@register("jaccard_modes", f"WITH {FIT}, {_TOP}, a AS (SELECT cell_id, k_idx, l_idx FROM top WHERE rank <= 20), b AS (SELECT c.cell_id, a.k_idx, a.l_idx FROM a JOIN (SELECT DISTINCT cell_id FROM top) c ON a.cell_id = (c.cell_id + 1) % 3), u AS (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b), g AS (SELECT cell_id, k_idx, l_idx, max(x) AS x, max(y) AS y FROM u GROUP BY 1, 2, 3) SELECT cell_id, {rnd('sum(x * y) / count(*)')} AS jaccard FROM g GROUP BY 1")
def jaccard_modes(spark, d):
    a = modes.top_modes(fit(spark, d), 20).select("cell_id", "k_idx", "l_idx")
    b = a.select(F.pmod(F.col("cell_id") - 1, F.lit(3)).alias("cell_id"), "k_idx", "l_idx")
    return rounded(modes.jaccard(a, b))


@register("relative_errors", f"""
WITH {FIT}, {_TOP}, w AS (SELECT *, {_WAVE} FROM top), t AS (SELECT cell_id, sum({flux_sql()}) AS ref, sum(CASE WHEN rank <= {TOP} THEN {flux_sql()} ELSE 0 END) AS val FROM w GROUP BY 1)
SELECT cell_id, {rnd('(val / ref - 1) * 100', 4)} AS rel_err, {rnd('(val - ref) / (SELECT arg_max(ref, abs(ref)) FROM t) * 100', 4)} AS max_err FROM t""")
def relative_errors(spark, d):
    w = wave(modes.top_modes(fit(spark, d), NHI * NHJ)).withColumn("uw", flux("ampl", "kk", "ll", 10.0, 0.0))
    t = w.groupBy("cell_id").agg(F.sum("uw").alias("ref"), F.sum(F.when(F.col("rank") <= TOP, F.col("uw")).otherwise(0.0)).alias("val"))
    return rounded(diagnostics.relative_errors(t, "val", "ref").select("cell_id", "rel_err", "max_err"), 4)


@register("sum_errors", f"WITH {FIT}, {_TOP} SELECT cell_id, {rnd('sqrt(sum(CASE WHEN rank > 10 THEN ampl * ampl ELSE 0 END))', 4)} AS l2, {rnd('sum(CASE WHEN rank <= 10 THEN ampl ELSE 0 END)', 4)} AS amplitude_sum, {rnd('abs(sum(CASE WHEN rank <= 10 THEN ampl ELSE 0 END) / sum(ampl) - 1) * 100', 4)} AS sum_err, {rnd('max(CASE WHEN rank > 10 THEN ampl ELSE 0 END) / max(ampl)', 5)} AS worst FROM top GROUP BY 1")
def sum_errors(spark, d):
    r = modes.top_modes(fit(spark, d), NHI * NHJ)
    kept, lost = (F.when(c, F.col("ampl")).otherwise(0.0) for c in (F.col("rank") <= 10, F.col("rank") > 10))
    return rounded(r.groupBy("cell_id").agg(F.sqrt(F.sum(lost * lost)).alias("l2"), F.sum(kept).alias("amplitude_sum"), (F.abs(F.sum(kept) / F.sum("ampl") - 1) * 100).alias("sum_err"), (F.max(lost) / F.max("ampl")).alias("worst")), 4, worst=5)


@register("vector_pack_pad", f"WITH {FIT}, {_TOP}, p AS (SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY l_idx, k_idx) - 1 AS pos, ampl FROM top WHERE rank <= {TOP} AND ampl > 0), q AS (SELECT DISTINCT cell_id, CAST(s AS BIGINT) AS pos FROM top, range(16) t(s)) SELECT cell_id, CAST(pos AS INT) AS pos, {rnd('coalesce(ampl, 0.0)', 4)} AS value FROM q LEFT JOIN p USING (cell_id, pos)")
def vector_pack_pad(spark, d):
    from ..operators.sinks import packed_spectra

    packed = packed_spectra(wave(modes.top_modes(fit(spark, d), TOP)), 16)
    return rounded(packed.select("cell_id", F.posexplode("ampl").alias("pos", "value")), 4)
