"""The decomposition of a raster into triangle pairs, and their refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decomposition as D
from ..sources import tables as T
from .base import RASTER, register, rnd, rounded
from .pairs import pair_errors, refined_pairs
from .pipeline import Settings
from .spectral_queries import flux_sql

ROWS, COLUMNS, TOLERANCE = 6, 3, 0.2
_LINES = f"""li AS (SELECT k, k * 49 // {ROWS - 1} AS at FROM range({ROWS}) t(k)), lj AS (SELECT k, k * 10 // {COLUMNS - 1} AS at FROM range({COLUMNS}) t(k)),
 bi AS (SELECT a.k, a.at AS lo, b.at AS hi, a.k = {ROWS - 2} AS last FROM li a JOIN li b ON b.k = a.k + 1), bj AS (SELECT a.k, a.at AS lo, b.at AS hi, a.k = {COLUMNS - 2} AS last FROM lj a JOIN lj b ON b.k = a.k + 1)"""
_NODES = f"""{RASTER}, {_LINES}, nodes AS (SELECT CAST(bi.k * {COLUMNS - 1} + bj.k AS INT) AS quad, i, j, z, i - bi.lo AS qi, j - bj.lo AS qj, bi.hi - bi.lo + CAST(bi.last AS INT) AS qni, bj.hi - bj.lo + CAST(bj.last AS INT) AS qnj,
   CAST((bi.k * {COLUMNS - 1} + bj.k) * 2 + CAST((i - bi.lo) * (bj.hi - bj.lo) + (j - bj.lo) * (bi.hi - bi.lo) > (bi.hi - bi.lo) * (bj.hi - bj.lo) AS INT) AS INT) AS tri_id
   FROM raster JOIN bi ON i >= bi.lo AND (i < bi.hi OR bi.last AND i = bi.hi) JOIN bj ON j >= bj.lo AND (j < bj.hi OR bj.last AND j = bj.hi))"""


def _located(spark, d):
    z = T.raster(spark, d)
    return D.located(z, D.grid_of(z, ROWS, COLUMNS))


@register("triangulation", f"""
WITH {_NODES}, q AS (SELECT DISTINCT bi.k AS qi, bj.k AS qj, bi.lo AS i0, bi.hi AS i1, bj.lo AS j0, bj.hi AS j1 FROM bi, bj),
     v AS (SELECT *, CAST(qi * {COLUMNS - 1} + qj AS INT) AS quad FROM q WHERE EXISTS (SELECT 1 FROM raster)),
     t AS (SELECT quad * 2 AS tri_id, [i0, i1, i0] AS iv, [j0, j0, j1] AS jv, [quad * 2 + 1, CASE WHEN qi > 0 THEN (quad - {COLUMNS - 1}) * 2 + 1 END, CASE WHEN qj > 0 THEN quad * 2 - 1 END] AS near FROM v
           UNION ALL SELECT quad * 2 + 1, [i1, i1, i0], [j0, j1, j1], [quad * 2, CASE WHEN qi < {ROWS - 2} THEN (quad + {COLUMNS - 1}) * 2 END, CASE WHEN qj < {COLUMNS - 2} THEN (quad + 1) * 2 END] FROM v),
     n AS (SELECT tri_id, count(*) AS n, {rnd('avg(z)')} AS z FROM nodes GROUP BY 1)
SELECT t.tri_id, array_to_string(iv, ',') AS i_verts, array_to_string(jv, ',') AS j_verts, {rnd('list_sum(iv) / 3.0')} AS ci, {rnd('list_sum(jv) / 3.0')} AS cj, array_to_string([x FOR x IN near IF x IS NOT NULL], ',') AS neighbours, n.n, n.z FROM t JOIN n USING (tri_id)""")
def triangulation(spark, d):
    """The triangles of the raster's decomposition with their vertices, centroids, neighbours and the nodes located in them."""
    z = T.raster(spark, d)
    t = D.triangles(spark, D.grid_of(z, ROWS, COLUMNS)).join(_located(spark, d).groupBy("tri_id").agg(F.count("*").alias("n"), F.avg("z").alias("z")), "tri_id")
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rounded(t.select("tri_id", flat("i_verts"), flat("j_verts"), "ci", "cj", flat("neighbours"), "n", "z"))


PAIR = Settings(nhi=3, nhj=3, n_modes=1, lmbda_fa=0.1, lmbda_sa=0.1)
CAP = 2
_BASIS = "2 * pi() * (m_i * qi / CAST(qni AS DOUBLE) + m_j * qj / CAST(qnj AS DOUBLE))"
_KK = "2 * pi() * m_i / (qni * 1000.0) AS kk, 2 * pi() * m_j / (qnj * 1000.0) AS ll"
_COLUMNS = 2 * (PAIR.nhi * PAIR.nhj - PAIR.nhj // 2) - 1


def _round(r: int) -> str:
    """The tables of round r over src{r} (quad, tri_id, qi, qj, qni, qnj, z), a whole lattice a quad: its basis is orthogonal there."""
    pen = f"{PAIR.lmbda_fa} * n * {0.5 * (_COLUMNS + 1) / _COLUMNS!r}"
    fit = f"""fs{r} AS (SELECT quad, k_idx, l_idx, m_i, m_j, sum(z * cos({_BASIS})) AS cs, sum(z * sin({_BASIS})) AS sn, count(*) AS n FROM src{r}, modes GROUP BY ALL),
 fa{r} AS (SELECT quad, k_idx, l_idx, m_i, m_j, cs / (CASE WHEN m_i = 0 AND m_j = 0 THEN n ELSE n / 2.0 END + {pen}) AS a_cos, CASE WHEN m_i = 0 AND m_j = 0 THEN 0 ELSE sn / (n / 2.0 + {pen}) END AS a_sin FROM fs{r}),
 tp{r} AS (SELECT * FROM fa{r} QUALIFY row_number() OVER (PARTITION BY quad ORDER BY sqrt(a_cos * a_cos + a_sin * a_sin) DESC, l_idx, k_idx) = 1),
 tz{r} AS (SELECT * REPLACE (z - avg(z) OVER (PARTITION BY tri_id) AS z) FROM src{r}),
 g{r} AS (SELECT s.quad, tri_id, k_idx, l_idx, m_i, m_j, sum(pow(cos({_BASIS}), 2)) AS uu, sum(cos({_BASIS}) * sin({_BASIS})) AS uv, sum(pow(sin({_BASIS}), 2)) AS vv, sum(z * cos({_BASIS})) AS uz, sum(z * sin({_BASIS})) AS vz FROM tz{r} s JOIN tp{r} t ON t.quad = s.quad GROUP BY ALL),
 p{r} AS (SELECT * REPLACE (uu + {PAIR.lmbda_sa} * (uu + vv) / 2 AS uu, vv + {PAIR.lmbda_sa} * (uu + vv) / 2 AS vv) FROM g{r}),
 sa{r} AS (SELECT quad, tri_id, k_idx, l_idx, m_i, m_j, sqrt(pow((uz * vv - vz * uv) / (uu * vv - uv * uv), 2) + pow((vz * uu - uz * uv) / (uu * vv - uv * uv), 2)) AS ampl FROM p{r})"""
    if r == 0:
        total = "tot0 AS (SELECT * FROM sa0)"
    else:
        total = f"""mix{r} AS (SELECT quad, tri_id, k_idx, l_idx, m_i, m_j, sum(delta) AS ampl FROM (SELECT t.*, ampl AS delta FROM tot{r - 1} t JOIN open{r - 1} USING (quad) UNION ALL SELECT s.*, -sign * ampl FROM sa{r} s JOIN open{r - 1} USING (quad)) GROUP BY ALL),
 tot{r} AS (SELECT * FROM (SELECT * FROM mix{r} WHERE ampl > 0 QUALIFY row_number() OVER (PARTITION BY tri_id ORDER BY ampl DESC, l_idx, k_idx) <= {PAIR.n_modes}) UNION ALL SELECT * FROM tot{r - 1} WHERE quad NOT IN (SELECT quad FROM open{r - 1}))"""
    judge = f"""w{r} AS (SELECT t.*, {_KK} FROM tot{r} t JOIN shapes USING (quad)), u{r} AS (SELECT quad, tri_id, {flux_sql()} AS uw FROM w{r}),
 err{r} AS (SELECT quad, coalesce(sum(uw) FILTER (WHERE tri_id % 2 = 0), 0) AS uw_0, coalesce(sum(uw) FILTER (WHERE tri_id % 2 = 1), 0) AS uw_1, any_value(ref) AS ref, (coalesce(sum(uw), 0) / any_value(ref)) - 1 AS err FROM refs LEFT JOIN u{r} USING (quad) GROUP BY quad),
 open{r} AS (SELECT quad, sign(err) AS sign FROM err{r} WHERE abs(err) > {TOLERANCE})"""
    turn = "1" if r == 0 else "-o.sign"
    recon = f"""re{r} AS (SELECT s.quad, tri_id, qi, qj, sum(a_cos * cos({_BASIS}) + a_sin * sin({_BASIS})) AS recon FROM src{r} s JOIN fa{r} f ON f.quad = s.quad GROUP BY ALL),
 ts{r} AS (SELECT re.quad, re.tri_id, re.qi, re.qj, {'0' if r == 0 else 'b.ts'} + {turn} * recon AS ts FROM re{r} re {'' if r == 0 else f'JOIN ts{r - 1} b USING (quad, tri_id, qi, qj) JOIN open{r - 1} o ON o.quad = re.quad'}),
 src{r + 1} AS (SELECT quad, tri_id, qi, qj, qni, qnj, y - avg(y) OVER (PARTITION BY quad) AS z FROM (SELECT s.quad, s.tri_id, s.qi, s.qj, s.qni, s.qnj, -sign * (s.z - ts) AS y FROM src0 s JOIN ts{r} t USING (quad, tri_id, qi, qj) JOIN open{r} o ON o.quad = s.quad))"""
    return ", ".join([fit, total, judge, *([recon] if r < CAP else [])])


_SHAPES = "shapes AS (SELECT DISTINCT quad, qni, qnj FROM nodes), src0 AS (SELECT quad, tri_id, qi, qj, qni, qnj, z - avg(z) OVER (PARTITION BY quad) AS z FROM nodes)"
_REFS = f"""waves AS (SELECT quad, qni, qnj, a AS m_i, b AS m_j FROM shapes, range(-6, 7) x(a), range(0, 4) y(b) WHERE a >= -(qni // 2) AND a < qni - qni // 2 AND b <= qnj // 2 AND (b > 0 OR a > 0)),
 dft AS (SELECT w.quad, m_i, m_j, w.qni, w.qnj, sum(z * cos(2 * pi() * (m_i * qi / CAST(w.qni AS DOUBLE) + m_j * qj / CAST(w.qnj AS DOUBLE)))) AS re, sum(z * sin(2 * pi() * (m_i * qi / CAST(w.qni AS DOUBLE) + m_j * qj / CAST(w.qnj AS DOUBLE)))) AS im FROM waves w JOIN src0 s ON s.quad = w.quad GROUP BY ALL),
 rw AS (SELECT quad, sqrt(re * re + im * im) / (qni * qnj / 2.0) AS ampl, {_KK} FROM dft), refs AS (SELECT quad, sum({flux_sql()}) AS ref FROM rw GROUP BY 1)"""
_MODES = f"modes AS (SELECT CAST(k AS INT) AS k_idx, CAST(l AS INT) AS l_idx, k AS m_i, l - {PAIR.nhj // 2} AS m_j FROM range({PAIR.nhi}) a(k), range({PAIR.nhj}) b(l) WHERE NOT (k = 0 AND l < {PAIR.nhj // 2}))"


@register("pair_refinement", f"""
WITH {_NODES}, {_SHAPES}, {_MODES}, {_REFS}, {', '.join(map(_round, range(CAP + 1)))}
SELECT quad, {rnd('ref', 4)} AS ref, {rnd('uw_0', 4)} AS uw_0, {rnd('uw_1', 4)} AS uw_1, {rnd('err', 5)} AS rel_err, abs(err) <= {TOLERANCE} AS converged,
       CAST(CASE WHEN quad IN (SELECT quad FROM open1) THEN 2 WHEN quad IN (SELECT quad FROM open0) THEN 1 ELSE 0 END AS INT) AS rounds FROM err{CAP}""")
def pair_refinement(spark, d):
    """Triangle pairs with one mode each, refined twice where they are off: the systems are 2 x 2, so SQL solves them as well."""
    pairs = refined_pairs(_located(spark, d), PAIR, tolerance=TOLERANCE, cap=CAP)[1]
    return rounded(pairs.select("quad", "ref", "uw_0", "uw_1", "rel_err", "converged", "rounds"), 4, rel_err=5)


@register("pair_diagnostics")
def pair_diagnostics(spark, d):
    """Errors of all pairs, refined to the end with three modes, given to both triangles."""
    pairs = refined_pairs(_located(spark, d), Settings(nhi=3, nhj=3, n_modes=3))[1]
    return rounded(pair_errors(pairs).join(pairs.select("quad", "uw_fa", "uw_sum", "uw_spec_sum", "converged"), "quad"), 4)
