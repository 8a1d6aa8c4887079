"""The decomposition against geometry, and pairs of triangles that close on their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogrid.operators import decomposition as D
from orogrid.plans import pairs
from orogrid.plans.pipeline import Settings


def inside(p, i, j):
    """Whether (i, j) lies in the triangle p, edges included."""
    a, b, c = p
    side = lambda u, v: (v[0] - u[0]) * (j - u[1]) - (v[1] - u[1]) * (i - u[0])
    s = [side(a, b), side(b, c), side(c, a)]
    return all(x >= 0 for x in s) or all(x <= 0 for x in s)


@pytest.mark.parametrize("shape", [(50, 11, 6, 3, 0), (23, 17, 4, 5, 2), (5, 5, 5, 5, 0), (7, 100, 2, 8, 1), (4, 4, 2, 2, 1)])
def test_nodes_lie_in_their_triangles(spark, shape):
    """Lines are the truncated even spread; every node between them has one triangle that holds it, neighbours share two vertices."""
    ni, nj, rows, columns, padding = shape
    nodes = spark.range(ni * nj).select(F.expr(f"cast(id div {nj} as int)").alias("i"), (F.col("id") % nj).cast("int").alias("j"), F.lit(1.0).alias("z"))
    grid = D.grid_of(nodes, rows, columns, padding)
    assert grid == D.Grid(ni, nj, rows, columns, padding)
    t = {r.tri_id: r for r in D.triangles(spark, grid).collect()}
    assert sorted(t) == list(range(2 * (rows - 1) * (columns - 1)))
    lines = [{padding + k * (n - 1 - 2 * padding) // (m - 1) for k in range(m)} for n, m in ((ni, rows), (nj, columns))]
    corners = {k: list(zip(r.i_verts, r.j_verts, strict=True)) for k, r in t.items()}
    assert [{c[a] for v in corners.values() for c in v} for a in (0, 1)] == lines
    for k, r in t.items():
        assert r.quad == k // 2 and (r.ci, r.cj) == pytest.approx((np.mean(r.i_verts), np.mean(r.j_verts)))
        assert r.neighbours[0] == k ^ 1
        assert {n for n in t if n != k and len(set(corners[n]) & set(corners[k])) == 2} == set(r.neighbours)
    got = D.located(nodes, grid).collect()
    assert len(got) == len({(r.i, r.j) for r in got}) == (ni - 2 * padding) * (nj - 2 * padding)
    assert all(inside(corners[r.tri_id], r.i, r.j) for r in got)
    for quad in {r.quad for r in got}:  # each quad is a whole lattice
        own = [r for r in got if r.quad == quad]
        assert {(r.qi, r.qj) for r in own} == {(a, b) for a in range(own[0].qni) for b in range(own[0].qnj)}


def test_grids_refuse_nonsense(spark):
    with pytest.raises(ValueError, match="two lines"):
        D.Grid(9, 9, 1, 3).checked()
    with pytest.raises(ValueError, match="more lines"):
        D.Grid(9, 9, 3, 8, 1).checked()
    with pytest.raises(ValueError, match="without nodes"):
        D.grid_of(spark.createDataFrame([], "i int, j int"), 2, 2)
    grid = D.Grid(9, 9, 3, 3)
    assert D.located(spark.createDataFrame([(None, 1), (1, None), (-1, 3), (9, 3)], "i int, j int"), grid).count() == 0


@pytest.fixture(scope="module")
def terrain(spark):
    """Two quads of 12 x 12: one wave that one mode fits, and one that needs more."""
    rows = [(i, j, 100 * math.cos(2 * math.pi * i / 12) if j < 12 else 80 * math.cos(2 * math.pi * (i + j) / 12) + 60 * math.sin(4 * math.pi * i / 12) + 5 * ((i * j) % 7)) for i in range(12) for j in range(24)]
    raster = spark.createDataFrame(rows, "i int, j int, z double")
    return D.located(raster, D.Grid(12, 24, 2, 3)).persist()


def test_pairs_close_on_their_own(spark, terrain):
    s = Settings(nhi=3, nhj=3, n_modes=2, lmbda_fa=1e-6, lmbda_sa=1e-2)
    run = lambda df, **o: [{r.quad: r for r in pairs.refined_pairs(df, s, tolerance=0.05, share=0.5, **o)[1].collect()}, o]
    both, _ = run(terrain, cap=2)
    assert both.keys() == {0, 1}
    assert both[0].rounds == 0 and both[0].converged
    assert both[1].rounds > 0
    alone, _ = run(terrain.where("quad = 1"), cap=2)
    for name in ("ref", "uw_fa", "uw_0", "uw_1", "rel_err", "rounds"):
        assert alone[1][name] == pytest.approx(both[1][name])
    first, _ = run(terrain, cap=0)
    assert abs(both[1].rel_err) < abs(first[1].rel_err)
    assert first[0].converged and not first[1].converged
    errors = pairs.pair_errors(spark.createDataFrame([tuple(r) for r in both.values()], list(both[0].asDict()))).collect()
    top = max((r.ref for r in both.values()), key=abs)
    assert {r.tri_id for r in errors} == {0, 1, 2, 3}
    for r in errors:
        p = both[r.quad]
        assert (r.rel_err, r.max_err) == (pytest.approx(p.rel_err * 100), pytest.approx((p.uw_sum - p.ref) / top * 100))


def test_flat_quads_are_not_refined(spark, terrain):
    flat = terrain.withColumn("z", F.lit(3.0))
    spectra, found = pairs.refined_pairs(flat, Settings(nhi=2, nhj=3, n_modes=1))
    assert {(r.quad, r.rel_err, r.rounds, r.converged) for r in found.collect()} == {(0, None, 0, True), (1, None, 0, True)}
    assert spectra.where("abs(ampl) > 1e-9").count() == 0
