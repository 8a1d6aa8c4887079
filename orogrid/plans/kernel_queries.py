"""Queries whose solves SQL cannot express; tests hold them against identities and brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..kernels import linear
from ..operators import fits, lattices
from ..operators import raster as R
from ..sources import tables as T
from ..sources.tables import NI, NJ
from .base import ORACLE, register, rnd, rounded
from .pipeline import Settings, approximated, compared, records, refined
from .raster_queries import inside_triangle
from .spectral_queries import _P, _TOP, _WAVE, DEMEANED, FIT, TRI, flux_sql


@register("pipeline_fa_sa")
def pipeline_fa_sa(spark, d):
    """The flagship: first fit, strongest modes, refit on the triangle, flux of every mode."""
    return rounded(approximated(T.cells_raster(spark, d), inside_triangle, Settings(), NI, NJ))


@register("cell_records")
def cell_records(spark, d):
    centres = T.mesh_cells(spark, d).select((F.col("cell_id") - 1).alias("cell_id"), F.radians("lat").alias("clat"), F.radians("lon").alias("clon"))
    return records(T.cells_raster(spark, d), centres, inside_triangle, Settings(), NI, NJ)


@register("refinement_loop")
def refinement_loop(spark, d):
    return rounded(refined(T.cells_raster(spark, d), inside_triangle, Settings(n_modes=6), NI, NJ))


_ONE = Settings(n_modes=1)


@register("pipeline_one_mode", f"""
WITH {FIT}, {_TOP}, {TRI[len(DEMEANED) + 2:]}, tz AS (SELECT cell_id, i, j, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM tri),
     b AS (SELECT t.cell_id, k_idx, l_idx, m_i, m_j, z, cos{_P} AS u, sin{_P} AS v FROM tz t JOIN top ON t.cell_id = top.cell_id AND rank = 1),
     g AS (SELECT cell_id, k_idx, l_idx, m_i, m_j, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * z) AS uz, sum(v * z) AS vz FROM b GROUP BY ALL),
     pen AS (SELECT * REPLACE (uu + {_ONE.lmbda_sa} * (uu + vv) / 2 AS uu, vv + {_ONE.lmbda_sa} * (uu + vv) / 2 AS vv) FROM g),
     a AS (SELECT *, (uz * vv - vz * uv) / (uu * vv - uv * uv) AS a_cos, (vz * uu - uz * uv) / (uu * vv - uv * uv) AS a_sin FROM pen),
     w AS (SELECT *, sqrt(a_cos * a_cos + a_sin * a_sin) AS ampl, {_WAVE} FROM a)
SELECT cell_id, k_idx, l_idx, {rnd('a_cos', 4)} AS a_cos, {rnd('a_sin', 4)} AS a_sin, {rnd('ampl', 4)} AS ampl, {rnd(flux_sql(), 5)} AS uw FROM w""")
def pipeline_one_mode(spark, d):
    """The whole approximation with one mode a cell, whose two equations SQL can solve as well."""
    out = approximated(T.cells_raster(spark, d), inside_triangle, _ONE, NI, NJ)
    return rounded(out.select("cell_id", "k_idx", "l_idx", "a_cos", "a_sin", "ampl", "uw"), 4, uw=5)


@register("pipeline_selected")
def pipeline_selected(spark, d):
    """The approximation with modes by matching pursuit and penalties by spatial cross-validation."""
    return rounded(approximated(T.cells_raster(spark, d), inside_triangle, Settings(nhi=5, nhj=4, n_modes=5, selector="omp", penalty="cv", alpha=1.0, folds=4), NI, NJ))


@register("pipeline_variants")
def pipeline_variants(spark, d):
    """Errors and fluxes of the baseline, isotropic, selected and joint settings of the pipeline."""
    own = {"nhi": 5, "nhj": 4, "n_modes": 5}
    variants = {"baseline": Settings(**own), "isotropic": Settings(**own, penalty="gcv"), "selected": Settings(**own, penalty="gcv", alpha=1.5), "joint": Settings(**own, penalty="joint")}
    return rounded(compared(T.cells_raster(spark, d), inside_triangle, variants, "baseline", NI, NJ)[1])


@register("full_spectrum_fit")
def full_spectrum_fit(spark, d):
    return rounded(approximated(T.cells_raster(spark, d), inside_triangle, Settings(nhi=4, nhj=4, full_spectrum=True, alpha=1.5), NI, NJ))


def gram_entries(blocks, side):
    """(cell_id, r, c, g) of every entry of the Gram matrices in block rows, those below the diagonal mirrored; with c -1 the right-hand sides'."""
    own = blocks.withColumn("width", F.when(F.col("bc") < 0, F.lit(1)).otherwise(F.least(F.lit(side), F.col("m") - F.col("bc") * side)))
    entries = own.select("cell_id", "br", "bc", "width", F.posexplode("values").alias("p", "g")).withColumn("r", F.expr(f"br * {side} + p div width").cast("int"))
    entries = entries.withColumn("c", F.when(F.col("bc") < 0, F.lit(-1)).otherwise(F.expr(f"bc * {side} + p % width")).cast("int"))
    mirror = entries.where("bc > br").select("cell_id", F.col("c").alias("r"), F.col("r").alias("c"), "g")
    return entries.select("cell_id", "r", "c", "g").unionByName(mirror)


def _triangle_blocks(spark, d, nhi, nhj, **options):
    """(modes by cell, block rows with the number m of columns) of a full small basis on the triangles' points."""
    from ..operators import modes

    z = inside_triangle(R.demeaned(T.cells_raster(spark, d))).where("inside").select("cell_id", "i", "j", "z")
    every = z.select("cell_id").distinct().crossJoin(F.broadcast(modes.mode_table(spark, nhi, nhj).where("not (m_i = 0 and m_j < 0)")))
    blocks = fits.normal_equations(z, every, NI, NJ, **options)
    sides = blocks.where("bc = -1").groupBy("cell_id").agg(F.sum(F.size("values")).cast("int").alias("m"))
    return z, every, blocks.join(sides, "cell_id")


@register("lsff_kernel_residual", "SELECT CAST(c AS BIGINT) AS cell_id, CAST(0 AS BIGINT) AS n_above FROM range(3) t(c) WHERE EXISTS (SELECT 1 FROM lineitem)")
def lsff_kernel_residual(spark, d):
    """How many entries of |(G + P) a - rhs| are above a tolerance, by cell: none."""
    z, every, blocks = _triangle_blocks(spark, d, 4, 4, block_columns=8)
    solved = fits.refit(z, every, NI, NJ, 0.1)
    order = F.array_sort(F.collect_list(F.struct("l_idx", "k_idx", "m_i", "m_j", "a_cos", "a_sin")))
    sines = F.filter(F.col("m"), lambda x: (x["m_i"] != 0) | (x["m_j"] != 0))["a_sin"]
    a = solved.groupBy("cell_id").agg(order.alias("m")).select("cell_id", F.posexplode(F.concat(F.col("m")["a_cos"], sines)).alias("c", "a"))
    entries = gram_entries(blocks, 8)
    mean = entries.where("r = c").groupBy("cell_id").agg(F.avg("g").alias("mean"))
    product = entries.where("c >= 0").join(a, ["cell_id", "c"]).groupBy("cell_id", "r").agg(F.sum(F.col("g") * F.col("a")).alias("ga"))
    both = product.join(a.withColumnRenamed("c", "r"), ["cell_id", "r"]).join(mean, "cell_id").join(entries.where("c = -1").drop("c"), ["cell_id", "r"])
    off = F.abs(F.col("ga") + 0.1 * F.col("mean") * F.col("a") - F.col("g")) > 1e-5
    return both.groupBy("cell_id").agg(F.sum(off.cast("long")).alias("n_above"))


@register("gram_in_blocks", f"""
WITH {TRI}, m AS (SELECT k AS m_i, l - 1 AS m_j, row_number() OVER (ORDER BY l, k) - 1 AS p FROM range(3) a(k), range(4) b(l) WHERE NOT (k = 0 AND l < 1)),
     q AS (SELECT 'cos' AS part, m_i, m_j, p AS c FROM m UNION ALL SELECT 'sin', m_i, m_j, row_number() OVER (ORDER BY p) + 10 FROM m WHERE NOT (m_i = 0 AND m_j = 0)),
     v AS (SELECT cell_id, i, j, z, c, CASE WHEN part = 'cos' THEN cos{_P} ELSE sin{_P} END AS v FROM tri, q)
SELECT cell_id, CAST(a.c AS INT) AS r, CAST(b.c AS INT) AS c, {rnd('sum(a.v * b.v)')} AS g FROM v a JOIN v b USING (cell_id, i, j) GROUP BY ALL
UNION ALL SELECT cell_id, CAST(c AS INT), -1, {rnd('sum(v * z)', 3)} FROM v GROUP BY ALL""")
def gram_in_blocks(spark, d):
    """Every entry of the triangles' normal equations, added up in blocks of 4 columns from blocks of 16 points through the tree."""
    blocks = _triangle_blocks(spark, d, 3, 4, block_columns=4, block_points=16)[2]
    return rounded(gram_entries(blocks, 4).withColumn("g", F.when(F.col("c") < 0, F.round(F.col("g") + 1.7e-8, 3)).otherwise(F.col("g"))))


_V = "v AS (SELECT vec_id AS cell_id, CAST((p - 1) // 8 AS INT) AS i, CAST((p - 1) % 8 AS INT) AS j, CAST(embedding[p] AS DOUBLE) AS z FROM embeddings, range(1, 65) r(p))"
_F = "f AS (SELECT n, CASE WHEN n < 4 THEN n ELSE n - 8 END / 8.0 AS f FROM range(8) r(n))"


@register("low_pass_field", f"""
WITH {_V}, {_F}, g AS (SELECT a.n AS k, b.n AS l, exp(-(pow(2 * pi() * a.f / 1000, 2) + pow(2 * pi() * b.f / 1000, 2)) / pow(2 * pi() / 5000, 2)) AS gain FROM f a, f b),
     h AS (SELECT di, dj, sum(gain * cos(2 * pi() * (k * di + l * dj) / 8.0)) / 64 AS w FROM g, range(8) x(di), range(8) y(dj) GROUP BY 1, 2),
     s AS (SELECT a.cell_id, a.i, a.j, sum(b.z * w) AS z FROM v a JOIN v b ON a.cell_id = b.cell_id JOIN h ON di = (a.i - b.i + 8) % 8 AND dj = (a.j - b.j + 8) % 8 GROUP BY 1, 2, 3)
SELECT cell_id, i, j, {rnd('z - avg(z) OVER (PARTITION BY cell_id)')} AS z FROM s""")
def low_pass_field(spark, d):
    return rounded(lattices.low_passed(T.vectors(spark, d), 1000.0, 1000.0))


@register("low_pass_in_runs", ORACLE["low_pass_field"])
def low_pass_in_runs(spark, d):
    """The same in runs of two columns, so that each lattice crosses three tasks on either way."""
    return rounded(lattices.low_passed(T.vectors(spark, d), 1000.0, 1000.0, run_values=16))


def _at(di: int, dj: int) -> str:
    return f"CASE WHEN n // 8 + {di} BETWEEN 0 AND 7 AND n % 8 + {dj} BETWEEN 0 AND 7 THEN p[n + {8 * di + dj} + 1] ELSE 0.0 END"


_CROSS, _DIAGONAL = (" + ".join(_at(*x) for x in near) for near in (((-1, 0), (1, 0), (0, -1), (0, 1)), ((-1, -1), (-1, 1), (1, -1), (1, 1))))
_IN = "n // 8 BETWEEN 2 AND 5 AND n % 8 BETWEEN 2 AND 5"


@register("taper_field", f"""
WITH RECURSIVE {_V}, t AS (SELECT 0 AS step, [CASE WHEN {_IN} THEN 1.0 ELSE 0.0 END FOR n IN range(64)]::DOUBLE[] AS p UNION ALL
     SELECT step + 1, [CASE WHEN {_IN} THEN 1.0 ELSE p[n + 1] + 0.5 * (0.5 * ({_CROSS} - 4 * p[n + 1]) + 0.5 * (({_DIAGONAL}) / 2 - 2 * p[n + 1])) END FOR n IN range(64)]::DOUBLE[] FROM t WHERE step < 20)
SELECT cell_id, i, j, {rnd('z * p[i * 8 + j + 1]')} AS z FROM v, t WHERE step = 20""")
def taper_field(spark, d):
    return _tapered(spark, d)


def _tapered(spark, d, **options):
    z = T.vectors(spark, d)
    p = lattices.diffused(z.withColumn("inside", F.col("i").between(2, 5) & F.col("j").between(2, 5)), 0, 20, **options)
    # tiles of like masks are small files: by their bytes Spark would broadcast every node
    return rounded(z.join(p.hint("merge"), ["cell_id", "i", "j"]).select("cell_id", "i", "j", (F.col("z") * F.col("p")).alias("z")))


@register("taper_in_tiles", ORACLE["taper_field"])
def taper_in_tiles(spark, d):
    """The same in tiles of 3 x 3 nodes whose borders are renewed every 2 steps."""
    return _tapered(spark, d, tile=3, halo=2)


@register("fft_spectrum", f"""
WITH {_V}, c AS (SELECT cell_id, i, j, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM v),
     s AS (SELECT cell_id, l, k, sum(z * cos(2 * pi() * (l * i + k * j) / 8.0)) AS re, sum(z * sin(2 * pi() * (l * i + k * j) / 8.0)) AS im FROM c, range(-4, 4) a(l), range(0, 5) b(k) GROUP BY 1, 2, 3)
SELECT cell_id, CAST(l + 4 AS INT) AS l_idx, CAST(k AS INT) AS k_idx, {rnd('sqrt(re * re + im * im) / 32')} AS ampl FROM s""")
def fft_spectrum(spark, d):
    return rounded(lattices.spectrum(R.demeaned(T.vectors(spark, d)), run_values=16))


def vector_systems(spark, d):
    """The sums of a 4 x 4 basis on every embedding's demeaned field."""
    from ..operators import modes

    z = R.demeaned(T.vectors(spark, d))
    every = z.select("cell_id").distinct().crossJoin(F.broadcast(modes.mode_table(spark, 4, 4).where("not (m_i = 0 and m_j < 0)")))
    return z, every, fits.systems(z, every, 8.0, 8.0)


# On the whole 8 x 8 lattice the basis is orthogonal: 64 on the diagonal for the constant, 32 for all other columns. Columns: cosines by (l, k), then sines.
_SUMS = f"""{_V}, c AS (SELECT cell_id, i, j, z - avg(z) OVER (PARTITION BY cell_id) AS z FROM v),
 m AS (SELECT k, l, row_number() OVER (ORDER BY l, k) - 1 AS pos FROM range(4) a(k), range(-1, 3) b(l) WHERE NOT (k = 0 AND l < 0)),
 q AS (SELECT 'cos' AS part, k, l, pos AS col FROM m UNION ALL SELECT 'sin', k, l, row_number() OVER (ORDER BY l, k) + 14 FROM m WHERE NOT (k = 0 AND l = 0)),
 s AS (SELECT cell_id, col, part, k, l, sum(z * CASE WHEN part = 'cos' THEN cos(2 * pi() * (k * i + l * j) / 8.0) ELSE sin(2 * pi() * (k * i + l * j) / 8.0) END) AS b, sum(z * z) AS total FROM c, q GROUP BY ALL),
 e AS (SELECT *, CASE WHEN k = 0 AND l = 0 THEN 64.0 ELSE 32.0 END AS d FROM s)"""
_MEAN = 32.0 * 30 / 29  # 29 columns
_GRID = f"grid AS (SELECT g, pow(10.0, -8 + g / 4.0) * {_MEAN!r} AS lam FROM range(41) r(g))"
_SCORES = "w AS (SELECT cell_id, alpha, g, lam, total, sum(d / (d + shift * lam)) AS h, sum(b * b * (2 - d / (d + shift * lam)) / (d + shift * lam)) AS fit FROM e, grid, shifts GROUP BY ALL), r AS (SELECT cell_id, alpha, g, lam, greatest(total - fit, 0.0) / pow(64 - h, 2) AS score FROM w)"


_TRIANGLE = f"""{TRI}, m AS (SELECT k AS m_i, l - 1 AS m_j, row_number() OVER (ORDER BY l, k) - 1 AS p FROM range(3) a(k), range(4) b(l) WHERE NOT (k = 0 AND l < 1)),
 q AS (SELECT 'cos' AS part, m_i, m_j, p AS c FROM m UNION ALL SELECT 'sin', m_i, m_j, row_number() OVER (ORDER BY p) + 10 FROM m WHERE NOT (m_i = 0 AND m_j = 0)),
 v AS (SELECT cell_id, i, j, z, c, CASE WHEN part = 'cos' THEN cos{_P} ELSE sin{_P} END AS v FROM tri, q)"""


@register("omp_on_triangles", f"""
WITH {_TRIANGLE}, g AS (SELECT cell_id, a.c AS a, b.c AS b, sum(a.v * b.v) AS g FROM v a JOIN v b USING (cell_id, i, j) GROUP BY ALL), r AS (SELECT cell_id, c, sum(v * z) AS r, sum(v * v) AS d FROM v GROUP BY ALL),
     one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY abs(r) / sqrt(d) DESC, c) = 1),
     left_ AS (SELECT r.cell_id, r.c, (r.r - g.g * one.r / one.d) / sqrt(r.d) AS left FROM r JOIN one USING (cell_id) JOIN g ON g.cell_id = r.cell_id AND g.a = r.c AND g.b = one.c WHERE r.c <> one.c),
     two AS (SELECT * FROM left_ QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY abs("left") DESC, c) = 1)
SELECT cell_id, CAST(0 AS INT) AS rank, CAST(c AS INT) AS col FROM one UNION ALL SELECT cell_id, 1, CAST(c AS INT) FROM two""")
def omp_on_triangles(spark, d):
    """Two picks on the triangles' points, where columns are not orthogonal: the second one looks at what the refit of the first leaves."""
    z, every, _ = _triangle_blocks(spark, d, 3, 4)
    return fits.by_system(fits.systems(z, every, NI, NJ), lambda s, *_: [(r, int(c)) for r, c in enumerate(linear.omp(s, 2))], "cell_id long, rank int, col int")


@register("gcv_on_triangles", f"""
WITH {TRI}, w AS (SELECT cell_id, z, cos(2 * pi() * (i / {NI}.0 + j / {NJ}.0)) AS u, sin(2 * pi() * (i / {NI}.0 + j / {NJ}.0)) AS v FROM tri),
     g AS (SELECT cell_id, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * z) AS uz, sum(v * z) AS vz, sum(z * z) AS zz, count(*) AS n FROM w GROUP BY 1),
     s AS (SELECT g.*, t.step, (uu + vv) / 2 AS md, pow(10.0, -8 + t.step / 4.0) * (uu + vv) / 2 AS lam FROM g, range(41) t(step)), shifted AS (SELECT *, lam * md AS p FROM s), q AS (SELECT *, (uu + p) * (vv + p) - uv * uv AS det FROM shifted),
     a AS (SELECT *, (uz * (vv + p) - vz * uv) / det AS a, (vz * (uu + p) - uz * uv) / det AS b, 2 - p * (uu + vv + 2 * p) / det AS h FROM q),
     e AS (SELECT cell_id, step, lam, greatest(zz - 2 * (a * uz + b * vz) + a * a * uu + 2 * a * b * uv + b * b * vv, 0) / pow(n - h, 2) AS score FROM a)
SELECT cell_id, {rnd('arg_min(lam, (score, step))')} AS lam, {rnd('min(score)', 4)} AS score FROM e GROUP BY 1""")
def gcv_on_triangles(spark, d):
    """The penalty of least GCV for one mode on the triangles' points, whose two columns are not orthogonal."""
    z, every, _ = _triangle_blocks(spark, d, 3, 4)
    return rounded(fits.by_system(fits.systems(z, every.where("m_i = 1 and m_j = 1"), NI, NJ), lambda s, *_: [linear.gcv(s)], "cell_id long, lam double, score double"), 6, score=4)


@register("omp_select", f"WITH {_SUMS} SELECT cell_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY abs(b) / sqrt(d) DESC, col) - 1 AS INT) AS rank, CAST(col AS INT) AS col FROM e QUALIFY rank < 6")
def omp_select(spark, d):
    return fits.by_system(vector_systems(spark, d)[2], lambda s, *_: [(r, int(c)) for r, c in enumerate(linear.omp(s, 6))], "cell_id long, rank int, col int")


@register("lasso_select", f"WITH {_SUMS}, t AS (SELECT *, greatest(abs(b) - 1e-3 * max(abs(b)) OVER (PARTITION BY cell_id), 0) / d AS w FROM e) SELECT cell_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY w DESC, col) - 1 AS INT) AS rank, CAST(col AS INT) AS col FROM t QUALIFY rank < 6")
def lasso_select(spark, d):
    return fits.by_system(vector_systems(spark, d)[2], lambda s, *_: [(r, int(c)) for r, c in enumerate(linear.lasso(s, 6))], "cell_id long, rank int, col int")


@register("gcv_lambda", f"WITH {_SUMS}, {_GRID}, shifts AS (SELECT 0.0 AS alpha, {_MEAN!r} AS shift), {_SCORES} SELECT cell_id, {rnd('arg_min(lam, (score, g))')} AS lam, {rnd('min(score)')} AS score FROM r GROUP BY 1")
def gcv_lambda(spark, d):
    return rounded(fits.by_system(vector_systems(spark, d)[2], lambda s, *_: [linear.gcv(s)], "cell_id long, lam double, score double"))


_ALPHAS = "shifts AS (SELECT alpha, avg(CASE WHEN alpha = 0 THEN 1.0 ELSE pow(sqrt(k * k + l * l) / sqrt(13.0) + 1e-3, alpha) END) * " + repr(_MEAN) + " AS shift FROM q, (VALUES (0.0), (0.5), (1.0), (1.5), (2.0), (3.0)) a(alpha) GROUP BY 1)"


@register("joint_gcv", f"WITH {_SUMS}, {_GRID}, {_ALPHAS}, {_SCORES} SELECT cell_id, {rnd('min(score)')} AS score FROM r GROUP BY 1")
def joint_gcv(spark, d):
    """The least score over exponents and penalties (several pairs may have it, as both only scale the mean penalty)."""
    rows = fits.by_system(vector_systems(spark, d)[2], lambda s, i, j: [linear.joint_gcv(s, linear.wavenumbers(i, j))], "cell_id long, alpha double, lam double, score double")
    return rounded(rows.select("cell_id", "score"))


@register("marginal_likelihood")
def marginal_likelihood(spark, d):
    return fits.by_system(vector_systems(spark, d)[2], lambda s, *_: [(linear.marginal_likelihood(s),)], "cell_id long, lam double")


@register("spatial_cv_lambda")
def spatial_cv_lambda(spark, d):
    z, every, _ = vector_systems(spark, d)
    return fits.spatial_cv(fits.fold_systems(z, every, 8.0, 8.0, 4, seed=0))


@register("selector_comparison")
def selector_comparison(spark, d):
    """Held-out errors of the three selectors on every embedding's field, and the overlap of their modes with the strongest."""
    from .pipeline import SELECTORS

    z, every, _ = vector_systems(spark, d)
    return rounded(fits.selector_errors(fits.fold_systems(z, every, 8.0, 8.0, 4, seed=0), SELECTORS, 5, 0.1, "top", 4))


_ANGLE = "(2 * pi() * epoch(ts) / 21600.0)"


@register("stream_daily_fit", f"""
WITH e AS (SELECT CAST(to_timestamp(floor(epoch(ts) / 21600) * 21600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, value AS z, cos{_ANGLE} AS c, sin{_ANGLE} AS s FROM events),
     g AS (SELECT start, count(*) AS n, sum(z * c) AS zc, sum(z * s) AS zs, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss FROM e GROUP BY 1)
SELECT start, n, CASE WHEN abs(cc * ss - cs * cs) > 1e-12 THEN {rnd('(zc * ss - zs * cs) / (cc * ss - cs * cs)', 4)} END AS a_cos, CASE WHEN abs(cc * ss - cs * cs) > 1e-12 THEN {rnd('(zs * cc - zc * cs) / (cc * ss - cs * cs)', 4)} END AS a_sin FROM g""")
def stream_daily_fit(spark, d):
    """The windowed fit over a table; the streaming test runs the same plan over a stream."""
    from ..streaming.incremental import windowed_fit

    e = T.read(spark, d, "events", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windowed_fit(e)
    return rounded(w.select(F.col("window.start").alias("start"), "n", "a_cos", "a_sin"), 4)
