"""Operators on small fixtures: fits, geometry, sinks, streaming."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orogrid.functions import geo
from orogrid.functions.geo import rad2deg_columns
from orogrid.kernels import fields, linear
from orogrid.operators import diagnostics, features, fits, joins, lattices, lsff, modes, segments, sinks
from orogrid.operators import raster as R
from orogrid.plans.pipeline import Settings, approximated, built_prior, empirical_alpha, first_fit, refined, resolved
from orogrid.plans.raster_queries import inside_triangle
from orogrid.session import shared_path
from orogrid.sources import fields as sources
from orogrid.sources import tables as T
from orogrid.sources import tiles
from orogrid.streaming.incremental import windowed_fit

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cells(spark):
    df = R.demeaned(T.cells_raster(spark, SF)).persist()
    return df


def test_rectangle_fit_equals_dense_solve(spark, cells):
    s = Settings(nhi=6, nhj=4)
    fa = first_fit(cells, s, 50, 11).where("cell_id = 1").toPandas().sort_values(["l_idx", "k_idx"])
    p = cells.where("cell_id = 1").toPandas()
    m = linear.basis(p.i.values, p.j.values, fa.m_i.values, fa.m_j.values, 50, 11)
    a = linear.solve(m.T @ m, m.T @ p.z.values, linear.isotropic(m.T @ m, s.lmbda_fa))
    assert np.allclose(fa.a_cos, a[: len(fa)], atol=1e-6)


def test_holes_take_the_general_fit(spark, cells):
    s = Settings(nhi=3, nhj=4)
    holed = cells.where("not (i = 3 and j = 2)")
    fa = first_fit(holed, s, 50, 11).where("cell_id = 2").toPandas().sort_values(["l_idx", "k_idx"])
    p = holed.where("cell_id = 2").toPandas()
    m = linear.basis(p.i.values, p.j.values, fa.m_i.values, fa.m_j.values, 50, 11)
    a = linear.solve(m.T @ m, m.T @ p.z.values, linear.isotropic(m.T @ m, s.lmbda_fa))
    assert np.allclose(fa.a_cos, a[: len(fa)], atol=1e-6)


def test_refit_equals_dense_solve_and_records_modes(spark, cells):
    s = Settings()
    out = approximated(cells, inside_triangle, s, 50, 11).toPandas()
    assert len(out) == 30
    p = R.demeaned(inside_triangle(cells).where("inside").select("cell_id", "i", "j", "z")).where("cell_id = 0").toPandas()
    o = out[out.cell_id == 0].sort_values(["l_idx", "k_idx"])
    m = linear.basis(p.i.values, p.j.values, o.m_i.values, o.m_j.values, 50, 11)
    a = linear.solve(m.T @ m, m.T @ p.z.values, linear.isotropic(m.T @ m, s.lmbda_sa))
    assert np.allclose(o.a_cos, a[:10], atol=1e-6)


def test_planted_modes_come_back(spark):
    rng = np.random.default_rng(777)
    wanted = {(1, 2): 30.0, (3, 1): 20.0, (5, 3): 10.0}
    i, j = (v.ravel() for v in np.meshgrid(np.arange(24), np.arange(12), indexing="ij"))
    z = sum(a * np.cos(2 * np.pi * (k * i / 24 + (l - 2) * j / 12) + rng.random()) for (k, l), a in wanted.items())
    points = spark.createDataFrame([(0, int(a), int(b), float(c)) for a, b, c in zip(i, j, z, strict=True)], "cell_id int, i int, j int, z double")
    top = modes.top_modes(first_fit(points, Settings(nhi=8, nhj=6, lmbda_fa=0.0), 24, 12), 3).toPandas()
    assert {(k, l): round(a, 6) for k, l, a in zip(top.k_idx, top.l_idx, top.ampl, strict=True)} == wanted


def test_refinement_brings_the_flux_closer_and_stops(spark, cells):
    out = refined(cells.where("cell_id = 1"), inside_triangle, Settings(n_modes=4), 50, 11, cap=1)
    assert out.count() == 4
    assert out.where("converged is null").count() == 0
    far = refined(cells.where("cell_id = 1"), inside_triangle, Settings(n_modes=2), 50, 11, tolerance=-1.0, cap=1)
    assert far.count() == far.where("not converged and round = 1").count() == 2  # never close enough: open at the end


def test_greedy_order_and_ties(spark):
    df = spark.createDataFrame([(0, 1, 0, 5.0), (0, 0, 0, 5.0), (0, 0, 1, 5.0), (0, 2, 2, float("nan")), (0, 3, 3, None)], "cell_id int, k_idx int, l_idx int, ampl double")
    got = [(r.k_idx, r.l_idx) for r in modes.top_modes(df, 3).orderBy("rank").collect()]
    assert got == [(0, 0), (1, 0), (0, 1)]
    assert modes.top_with_ties(df.where("ampl = 5.0"), 1).count() == 3


def test_odd_and_even_wavenumbers():
    assert modes.wavenumbers_l(10) == (-4, 5)
    assert modes.wavenumbers_l(11) == (-5, 5)


def test_basis_has_the_stated_number_of_columns(spark):
    assert modes.basis_columns(modes.mode_table(spark, 12, 10)).count() == 2 * 12 * 10 - 10 + 1


def test_polygon_edges_count_as_inside(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(0.0, 0.0, True), (1.0, 0.0, True), (2.0, 1.0, True), (1.0, 1.0, True), (2.1, 1.0, False), (-0.1, 2.0, False), (1.0, 2.0, True)], "x double, y double, want boolean")
    assert df.where(geo.in_polygon("x", "y", square) != F.col("want")).count() == 0


def test_expansion_moves_first_extremes_only(spark):
    df = spark.createDataFrame([([10.0, 12.0, 12.0],), ([89.5, 80.0, 85.0],)], "v array<double>")
    got = [r[0] for r in df.select(geo.expand_extremes("v", 1.0, False, 1.0)).collect()]
    assert got == [[9.0, 13.0, 12.0], [89.5, 79.0, 85.0]]
    assert df.select(geo.expand_extremes(F.array(F.lit(179.5), F.lit(178.0)), 1.0, True)).head()[0] == [-179.5, 177.0]


def test_memory_by_latitude(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (59.9,), (-70.0,), (85.0,)], "lat double").select(geo.memory_gb("lat")).collect()]
    assert got[0] == got[1] == 10.0
    assert got[2] == pytest.approx(10 / math.cos(math.radians(70)) ** 0.7)
    assert got[3] == 60.0


def test_nearest_with_no_cells_gives_no_rows(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, lat double, lon double")
    c = spark.createDataFrame([], "cell_id long, lat double, lon double")
    assert joins.nearest(p, c, ["lat", "lon"], "point_id", "cell_id").count() == 0


def brute_nearest(points, cells):
    out = []
    for p, *x in points:
        near = [(sum(abs(a - b) for a, b in zip(x, y, strict=True)), c) for c, *y in cells if all(v is not None and math.isfinite(v) for v in y)] if all(v is not None and math.isfinite(v) for v in x) else []
        out.append((p, min(near)[1] if near else None, min(near)[0] if near else None))
    return sorted(map(repr, out))


def test_nearest_loses_no_point(spark, monkeypatch):
    """Cells a hair apart and points a world away, gaps of many scales, null and endless coordinates, ties, repeats and null ids."""
    nan, inf = float("nan"), float("inf")
    cells = [(k, 1e-7 * k, 0.0) for k in range(1, 40)] + [(100, 5e5, 5e5), (101, 5e5, 5e5), (102, None, 1.0), (103, nan, 1.0), (104, 1.0, inf)]
    points = [(1, 1e6, 1e6), (2, 0.0, 0.0), (3, None, 1.0), (4, nan, 2.0), (5, -inf, 2.0), (6, 3e-7, 1e-8), (6, 4e-7, 0.0), (7, 1.0, 1.0), (7, 1.0, 1.0), (None, 2.5e5, 2.5e5), (8, -1e6, 0.0), (9, 10.0, -1000.0)]
    frames = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(cells, "cell_id long, lat double, lon double")
    for large in (4096, 3):
        monkeypatch.setattr(joins, "LARGE_BIN", large)
        got = joins.nearest(*frames, ["lat", "lon"], "point_id", "cell_id").collect()
        assert sorted(map(repr, map(tuple, got))) == brute_nearest(points, cells)
        boxed = joins.nearest(*frames, ["lat", "lon"], "point_id", "cell_id", exact=False).collect()
        assert sum(r.cell_id is not None for r in boxed) == 9 and len(boxed) == 12
    alone = joins.nearest(frames[0].where("point_id in (3, 4)"), frames[1], ["lat", "lon"], "point_id", "cell_id").collect()
    assert [(r.cell_id, r.distance) for r in alone] == [(None, None)] * 2
    sphere = joins.nearest_great_circle(spark.createDataFrame([(1, 10.0, 20.0), (2, None, 0.0), (3, nan, 0.0)], "point_id long, lat double, lon double"), spark.createDataFrame([(1, 80.0, 0.0), (2, 11.0, 20.0)], "cell_id long, lat double, lon double"), "point_id", "cell_id")
    assert {r.point_id: r.cell_id for r in sphere.collect()} == {1: 2, 2: None, 3: None}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    for n, m in ((300, 40), (40, 300)):
        cells = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(m, 2)) ** 3)]
        points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(n, 2)) ** 3)]
        got = joins.nearest(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(cells, "cell_id long, lat double, lon double"), ["lat", "lon"], "point_id", "cell_id").collect()
        assert sorted(map(repr, map(tuple, got))) == brute_nearest(points, cells)


def test_many_points_and_cells_at_one_place(spark, monkeypatch):
    """Equal places are met once (200,000 points times as many cells there would be 40 billion pairs), large sides are not broadcast, and nothing else changes."""
    monkeypatch.setattr(joins, "SMALL_SIDE", 0)
    points = spark.range(200_000).selectExpr("id as point_id", "double(id % 2) * 10 as lat", "double(id % 3) as lon")
    cells = spark.range(200_001).selectExpr("200000 - id as cell_id", "double(id % 2) * 10.25 as lat", "double(0) as lon")
    got = joins.nearest_great_circle(points, cells, "point_id", "cell_id")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    one = got.groupBy(F.col("point_id") % 6).agg(F.count("*"), F.min("cell_id"), F.max("cell_id"), F.min("distance"), F.max("distance")).collect()
    assert sum(r[1] for r in one) == 200_000 and all(r[2] == r[3] == r[0] % 2 for r in one)
    assert all(r[4] == pytest.approx(r[5]) for r in one) and {round(np.degrees(r[4]), 9) for r in one if r[0] in (0, 2, 4)} == {0.0, 1.0, 2.0}


def test_box_rule_can_differ_from_the_nearest(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, lat double, lon double")
    c = spark.createDataFrame([(1, 0.95, 0.95), (2, 1.05, 0.0)], "cell_id long, lat double, lon double")
    assert joins.nearest(p, c, ["lat", "lon"], "point_id", "cell_id", 1.0, exact=False).head().cell_id == 1
    assert joins.nearest(p, c, ["lat", "lon"], "point_id", "cell_id", 1.0).head().cell_id == 2


def test_packed_spectra_pad_and_reject_overflow(spark):
    df = spark.createDataFrame([(0, 1, 2, 3.0), (0, 0, 1, 2.0), (0, 0, 0, 0.0)], "cell_id int, k_idx int, l_idx int, ampl double")
    assert sinks.packed_spectra(df, 4, values=("ampl",)).head().ampl == [2.0, 3.0, 0.0, 0.0]
    with pytest.raises(Exception, match="more positive modes"):
        sinks.packed_spectra(df, 1, values=("ampl",)).collect()


def test_append_is_idempotent_and_rejects_partial_records(spark):
    schema = "cell_id long, is_land int, clat double, clon double, dk double, dl double, h_spec array<double>"
    whole = spark.createDataFrame([(1, 0, 0.1, 0.2, None, None, None), (205, 1, 0.1, 0.2, 1.0, 1.0, [0.0, 2.0])], schema)
    path = shared_path(spark, "append")
    assert sinks.append_missing(whole, path).count() == 2
    assert sinks.append_missing(whole.unionByName(whole), path).count() == 2
    bad = shared_path(spark, "append")
    sinks.append_missing(spark.createDataFrame([(1, 1, 0.1, 0.2, 1.0, 1.0, [0.0])], schema), bad)
    with pytest.raises(ValueError, match="incomplete"):
        sinks.append_missing(whole, bad)


def test_slope_of_a_planted_power_law(spark):
    ks = np.linspace(0.02, 0.5, 200)
    df = spark.createDataFrame([(float(k), float(k**-2.0)) for k in ks] + [(0.3, -1.0), (0.9, 5.0)], "kmag double, power double")
    r = diagnostics.radial_slope(df).head()
    assert r.alpha == pytest.approx(2.0, abs=0.05)
    assert diagnostics.radial_slope(df.limit(1)).count() == 0


def test_empty_cells(spark):
    empty = spark.createDataFrame([], "cell_id long, i int, j int, z double")
    assert fits.by_cell(empty, lambda i, j, z: [(1.0,)], "cell_id long, x double").count() == 0
    modes_ = spark.createDataFrame([], "cell_id long, k_idx int, l_idx int, m_i int, m_j int")
    assert fits.refit(empty, modes_, 8.0, 8.0, 0.1).count() == 0


@pytest.fixture(scope="module")
def lattice(spark):
    """Two 12 x 10 cells of noise, the modes of a 3 x 4 table, and the dense matrices of the first."""
    rng = np.random.default_rng(3)
    rows = [(c, i, j, float(v)) for c in (1, 2) for (i, j), v in np.ndenumerate(rng.standard_normal((12, 10)).cumsum(axis=0))]
    points = spark.createDataFrame(rows, "cell_id long, i int, j int, z double")
    table = modes.mode_table(spark, 3, 4).where("not (m_i = 0 and m_j < 0)")
    every = points.select("cell_id").distinct().crossJoin(table)
    t = table.orderBy("l_idx", "k_idx").toPandas()
    i, j, z = (np.array([r[k] for r in rows if r[0] == 1], float) for k in (1, 2, 3))
    return points, every, (linear.basis(i, j, t.m_i.values, t.m_j.values, 12, 10), z, i, j, linear.wavenumbers(t.m_i.values, t.m_j.values))


def dense(rows, split=()):
    """{values of split: (gram, rhs, n, total)} of one cell's collected block rows."""
    out = {}
    for key in {tuple(r[c] for c in split) for r in rows if r["br"] >= 0}:
        own = [r for r in rows if r["br"] >= 0 and tuple(r[c] for c in split) == key]
        rhs = np.concatenate([r["values"] for r in sorted((r for r in own if r["bc"] < 0), key=lambda r: r["br"])])
        side = max(len(r["values"]) for r in own if r["bc"] < 0)
        gram = np.full((len(rhs),) * 2, np.nan)
        for r in own:
            if r["bc"] >= 0:
                block = np.reshape(r["values"], (min(side, len(rhs) - r["br"] * side), -1))
                gram[r["br"] * side :, r["bc"] * side :][: block.shape[0], : block.shape[1]] = block
                gram[r["bc"] * side :, r["br"] * side :][: block.shape[1], : block.shape[0]] = block.T
        assert {(r["n"], r["total"]) for r in own} == {(own[0]["n"], own[0]["total"])}
        out[key] = gram, rhs, own[0]["n"], own[0]["total"]
    return out


def test_sums_of_blocks_equal_the_dense_system(spark, lattice, monkeypatch):
    """Few and many blocks of points and of columns; with 7 points a block the tree has two levels. No row is larger than its block."""
    points, every, (m, z, *_) = lattice
    monkeypatch.setattr(fits, "FAN", 4)
    for size, columns in ((1000, 128), (7, 128), (7, 5), (40, 1)):
        rows = fits.systems(points, every, 12.0, 10.0, block_points=size, block_columns=columns).where("cell_id = 1").collect()
        assert all(len(r["values"]) <= columns * columns for r in rows if r["br"] >= 0)
        gram, rhs, n, total = dense(rows)[()]
        assert np.allclose(gram, m.T @ m)
        assert np.allclose(rhs, m.T @ z)
        assert (n, total) == (120, pytest.approx(z @ z))
        own = fits.refit(points, every, 12.0, 10.0, 0.1, block_points=size, block_columns=columns).where("cell_id = 1").orderBy("l_idx", "k_idx").toPandas()
        assert np.allclose(own.a_cos, linear.solve(m.T @ m, m.T @ z, linear.isotropic(m.T @ m, 0.1))[: len(own)])


def test_sums_of_a_tree_do_not_depend_on_the_order_of_rows(spark):
    """Totals that round differently in another order: block rows whose parts arrive in any order add up alike."""
    schema = "cell_id long, block int, br int, bc int, n long, total double, values array<double>"
    totals = [1.0, 1e16, 1.0, -1e16, 3.0]
    orders = [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0), (1, 3, 0, 2, 4)]
    rows = [(1, 0, 0, c, 1, totals[k], [totals[k]], k) for c, order in enumerate(orders) for k in order]
    got = fits._added(spark.createDataFrame(rows, f"{schema}, part int").coalesce(1), ["cell_id", "block", "br", "bc"], schema).collect()
    assert len(got) == 3 and {(r["n"], r["total"], r["values"][0]) for r in got} == {(5, got[0]["total"], got[0]["total"])}


def test_fold_sums_equal_folds_of_points(spark, lattice):
    points, every, (m, z, i, j, k) = lattice
    for alpha in (0.0, 1.5):
        row = fits.spatial_cv(fits.fold_systems(points, every, 12.0, 10.0, 4, 0.1, 3), alpha).where("cell_id = 1").head()
        want = linear.spatial_cv_points(m, z, j, i, 4, 0.1, 3, k=k if alpha else None, alpha=alpha)
        assert (row["lam"], row["mse"]) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_fold_membership_equals_the_kernel(spark):
    """Folds by SQL expressions and by NumPy, on odd places and edges, for buffers below and above a side."""
    rng = np.random.default_rng(4)
    x, y = np.append(rng.uniform(0, 12, 300), [0, 12, 4, 6.0]), np.append(rng.uniform(-3, 5, 300), [5, -3, 1, 1.0])
    points = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "cell_id long, id int, j double, i double")
    for n, buffer in ((5, 0.0), (5, 0.1), (4, 1.0), (3, 1.7)):
        t = linear.Tiling.drawn((x.min(), x.max()), (y.min(), y.max()), n, 2)
        place, line = (F.col("j") - F.col("left")) / F.col("wide"), (F.col("i") - F.col("bottom")) / F.col("high")
        got = points.join(fits.tilings(points, n, 2), "cell_id").select("id", F.explode(fits.folds_of(place, line, buffer)).alias("f"))
        assert {(r.f, r.id) for r in got.collect()} == set(zip(*(a.tolist() for a in np.nonzero(t.members(x, y, buffer))), strict=True))


def test_selectors_and_priors_reach_the_fit(spark, lattice):
    points, every, (m, z, _, _, k) = lattice
    inside = lambda df: df.withColumn("inside", F.lit(True))
    own = {"nhi": 3, "nhj": 4, "n_modes": 3}
    zero = z - z.mean()
    picked = linear.omp(linear.System.of(m, zero), 3)
    got = approximated(points, inside, Settings(**own, selector="omp"), 12, 10).where("cell_id = 1").toPandas()
    t = every.where("cell_id = 1").orderBy("l_idx", "k_idx").toPandas()
    names = list(zip(t.k_idx, t.l_idx, strict=True))
    columns = names + [n for n, w in zip(names, (t.m_i != 0) | (t.m_j != 0), strict=True) if w]
    assert {columns[c] for c in picked} <= set(zip(got.k_idx, got.l_idx, strict=True))
    assert len(got) == 3
    called = approximated(points, inside, Settings(**own, selector=lambda s, n: np.array([4, 5, 6])), 12, 10).where("cell_id = 1").toPandas()
    assert set(zip(called.k_idx, called.l_idx, strict=True)) == {columns[c] for c in (4, 5, 6)}
    for penalty, want in (("gcv", lambda s, k: (1.5, linear.gcv(s, k, 1.5)[0])), ("evidence", lambda s, k: (1.5, linear.marginal_likelihood(s))), ("joint", lambda s, k: linear.joint_gcv(s, k)[:2])):
        out = approximated(points, inside, Settings(**own, full_spectrum=True, penalty=penalty, alpha=1.5), 12, 10).where("cell_id = 1").orderBy("l_idx", "k_idx").toPandas()
        s = linear.System.of(m, zero)
        alpha, lam = want(s, k)
        assert np.allclose(out.a_cos, linear.solve(s.gram, s.rhs, linear.spectral(s.gram, lam, k, alpha))[: len(out)])
    flat = fits.refit(points, every, 12.0, 10.0, 0.0, prior=lambda s, i, j, lam: np.full(len(s.rhs), 5.0)).where("cell_id = 1").orderBy("l_idx", "k_idx").toPandas()
    assert np.allclose(flat.a_cos, linear.solve(m.T @ m, m.T @ z, 5.0)[: len(flat)])
    with pytest.raises(Exception, match="weights for"):
        fits.refit(points, every, 12.0, 10.0, 0.0, prior=lambda s, i, j, lam: np.ones(2)).collect()


def test_selectors_are_compared_by_nested_folds(spark, lattice):
    """Against dense folds of points: modes chosen, fitted and judged fold by fold."""
    points, every, (m, z, i, j, _) = lattice
    t = every.where("cell_id = 1").orderBy("l_idx", "k_idx").toPandas()
    count, waves = len(t), np.flatnonzero(((t.m_i != 0) | (t.m_j != 0)).values)
    column, n, lam = [*range(count), *waves.tolist()], 4, 0.2

    def top(s):
        a = linear.solve(s.gram, s.rhs, linear.isotropic(s.gram, lam))
        size = [np.hypot(a[k], a[count + waves.tolist().index(k)] if k in waves else 0.0) for k in range(count)]
        return sorted(range(count), key=lambda k: -size[k])[:n]

    picks = {"top": top, "omp": lambda s: list(dict.fromkeys(column[c] for c in linear.omp(s, 2 * n)))[:n], "lasso": lambda s: list(dict.fromkeys(column[c] for c in linear.lasso(s, 2 * n)))[:n]}
    want = {}
    for name, pick in picks.items():
        errors = []
        for train, held in linear.folds(j, i, 4, 0.1, 3):
            own = [c for c in range(m.shape[1]) if column[c] in pick(linear.System.of(m[train], z[train]))]
            g = m[train][:, own]
            a = linear.solve(g.T @ g, g.T @ z[train], linear.isotropic(g.T @ g, lam))
            errors.append(np.mean((z[held] - m[held][:, own] @ a) ** 2))
        mine, base = (set(p(linear.System.of(m, z))) for p in (pick, top))
        want[name] = len(mine & base) / len(mine | base), np.mean(errors)
    folds = fits.fold_systems(points, every, 12.0, 10.0, 4, 0.1, 3, block_columns=5)
    got = {r.selector: (r.jaccard, r.mse) for r in fits.selector_errors(folds, {"top": None, "omp": linear.omp, "lasso": linear.lasso}, n, lam, "top", 4).where("cell_id = 1").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_priors_are_built_by_their_rules(spark, lattice):
    points, every, (m, z, i, j, k) = lattice
    inside = R.demeaned(points)
    s = linear.System.of(m, z - z.mean())
    one = lambda **o: tuple(built_prior(points, inside, every, 12, 10, n_folds=4, seed=3, **o).where("cell_id = 1").select("alpha", "lam").head())
    assert one(joint=True, alpha=9.0) == pytest.approx(linear.joint_gcv(s, k)[:2])
    assert one(alpha=1.5, lam=0.2) == (1.5, 0.2)
    assert one(alpha=1.5, coords=False) == pytest.approx((1.5, linear.gcv(s, k, 1.5)[0]))
    assert one(alpha=1.5) == pytest.approx((1.5, linear.spatial_cv_points(m, z - z.mean(), j, i, 4, 0.1, 3)[0]))
    slope = empirical_alpha(points, 12, 10).where("cell_id = 1").head().alpha
    assert one(lam=0.2) == (pytest.approx(slope), 0.2)


def test_empirical_alpha_of_a_planted_power_law(spark):
    f = fields.power_law(32, 3.0, 7)
    points = spark.createDataFrame([(1, i, j, float(v)) for (i, j), v in np.ndenumerate(f)], "cell_id long, i int, j int, z double")
    assert empirical_alpha(points, 32, 32).head().alpha == pytest.approx(3.0, abs=0.6)


def test_coarse_setting_fits_the_points_inside(spark, lattice):
    points, _, (m, z, i, j, _) = lattice
    half = lambda df: df.withColumn("inside", F.col("i") + F.col("j") < 12)
    s = Settings(nhi=3, nhj=4, n_modes=3, cg_spsp=True)
    got = approximated(points, half, s, 12, 10).where("cell_id = 1").toPandas()
    near, zero = i + j < 12, z - z.mean()
    a = linear.solve(m[near].T @ m[near], m[near].T @ (zero[near] - zero[near].mean()), linear.isotropic(m[near].T @ m[near], 0.1))
    names = [(r.k_idx, r.l_idx, r.m_i != 0 or r.m_j != 0) for r in modes.mode_table(spark, 3, 4).where("not (m_i = 0 and m_j < 0)").orderBy("l_idx", "k_idx").collect()]
    sine = iter(a[len(names) :])
    size = {n[:2]: np.hypot(c, next(sine) if n[2] else 0) for n, c in zip(names, a, strict=False)}
    assert set(zip(got.k_idx, got.l_idx, strict=True)) == set(sorted(size, key=lambda n: -size[n])[:3])
    assert len(got) == 3
    assert not s.rect


def test_sidecar_verifies_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 2.0, 3.0, None, None, None), (2, 1, 1.0, 3.0, None, None, None)], "cell_id long, is_land int, clat double, clon double, dk double, dl double, h_spec array<double>")
    got = spark.read.parquet(sinks.write_sidecar(rows, f"file://{tmp_path}/records"))
    assert sorted(map(tuple, got.select("cell_id", "is_land", "complete").collect())) == [(1, 0, True), (2, 1, False)]


def test_spectral_prior_uses_whole_wavenumbers(spark, lattice):
    points, every, (m, z, _, _, k) = lattice
    out = fits.refit(points, every, 12.0, 10.0, 0.3, 2.0).where("cell_id = 1").orderBy("l_idx", "k_idx").toPandas()
    g = m.T @ m
    a = linear.solve(g, m.T @ z, 0.3 * np.trace(g) / len(g) * (k / k.max() + 1e-3) ** 2)
    assert np.allclose(out.a_cos, a[: len(out)])


def test_options_resolve_in_order():
    s = resolved({"alpha": 2.0, "n_modes": None}, {"alpha": 1.0, "n_modes": 7})
    assert (s.alpha, s.n_modes, s.nhi) == (2.0, 7, Settings().nhi)
    with pytest.raises(ValueError, match="compulsory"):
        resolved({}, {"tag": None}, ("tag",))
    with pytest.raises(ValueError, match="unknown"):
        resolved({"nope": 1})
    with pytest.raises(ValueError, match="selector"):
        Settings(selector="nope")
    with pytest.raises(ValueError, match="penalty"):
        Settings(penalty="nope")


def test_equal_points_stay_apart_in_a_reconstruction(spark):
    points = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 0, 5.0), (2, 0, 0, 1.0)], "cell_id long, i int, j int, z double")
    modes_ = spark.createDataFrame([(1, 0, 0, 2.0, 0.0), (1, 1, 0, 3.0, 9.0)], "cell_id long, m_i int, m_j int, a_cos double, a_sin double")
    got = lsff.reconstruction(points, modes_, 8, 8, ("cell_id",)).collect()
    assert [(r.cell_id, r.recon) for r in got] == [(1, 5.0)] * 2


def test_dense_bins_are_dealt_out(spark, monkeypatch):
    """Cells and points in one spot: parts of a bin give what the whole bin gives, and the first radius follows the density."""
    rng = np.random.default_rng(0)
    cells = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 0.01, (200, 2)))] + [(999, 50.0, 50.0)]
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 0.01, (50, 2)))]
    frames = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(cells, "cell_id long, lat double, lon double")
    want = {p: min((abs(x - a) + abs(y - b), c) for c, a, b in cells)[1] for p, x, y in points}
    for size in (4096, 16):
        monkeypatch.setattr(joins, "LARGE_BIN", size)
        got = {r.point_id: r.cell_id for r in joins.nearest(*frames, ["lat", "lon"], "point_id", "cell_id").collect()}
        assert got == want
    assert joins.first_radius(frames[1], ["lat", "lon"]) == pytest.approx(5.0, rel=0.05)
    assert joins.first_radius(frames[1].limit(0), ["lat"]) == 1.0


def test_two_writers_and_partial_records(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    rows = spark.createDataFrame([(1, 0, 2.0, 3.0, None, None, None), (1, 0, 1.0, 3.0, None, None, None), (205, 0, 1.0, 1.0, None, None, None)], "cell_id long, is_land int, clat double, clon double, dk double, dl double, h_spec array<double>")
    assert sorted((r.cell_id, r.clat) for r in sinks.append_missing(rows, path).collect()) == [(1, 1.0), (205, 1.0)]
    assert sinks.append_missing(rows, path).count() == 2
    assert sinks.create_new(spark, f"{path}._writing")
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.append_missing(rows, path)


def test_versions_and_parameters(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for k in range(3):
        sinks.write_versioned(spark.range(k, k + 1), path, {"n": k, "name": "x", "shape": (1, 2)})
    assert [spark.read.parquet(p).head()[0] for p in (path, f"{path}_old")] == [2, 1]
    assert {r.name: r.value for r in spark.read.parquet(f"{path}_params").collect()} == {"n": "2", "name": "x", "shape": "(1, 2)"}


def test_strict_merge_raises_on_gaps_and_repeats(spark):
    whole = spark.createDataFrame([(k, k % 2) for k in range(5)], "cell_id long, is_land int")
    assert sinks.cover_counts(sinks.merged_strictly(whole, 0, 4)).head().asDict() == {"n": 5, "n_land": 2, "n_ocean": 3}
    for bad in (whole.where("cell_id <> 2"), whole.unionByName(whole.limit(1)), whole.withColumn("cell_id", F.col("cell_id") + 1)):
        with pytest.raises(Exception, match="do not hold each id"):
            sinks.merged_strictly(bad, 0, 4).collect()


def test_files_are_audited_by_size(spark, tmp_path):
    for name, size in (("a.nc", 10), ("b.nc", 200), ("c.nc", 5000), ("d.txt", 200)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.name: (r.length, r.verdict) for r in tiles.file_audit(spark, f"file://{tmp_path}", bounds=(100, 1000)).collect()}
    assert got == {"a.nc": (10, "too small"), "b.nc": (200, "ok"), "c.nc": (5000, "too large")}


def test_tiles_of_whole_circles_and_both_names(spark):
    e = spark.createDataFrame([(0, -91.0, -80.0, -180.0, 180.0), (1, 0.0, 10.0, 179.0, -179.0)], "cell_id long, lat_min double, lat_max double, lon_min double, lon_max double")
    got = tiles.tiles_of(tiles.widened(e, 1.0)).groupBy("cell_id").agg(F.count("*").alias("n"), F.count_distinct("tile_id").alias("t")).orderBy("cell_id").collect()
    assert [(r.n, r.t) for r in got] == [(24, 24), (4, 4)]
    names = {r.name for r in tiles.tile_grid(spark, 30).where("tile_id in (0, 12, 71)").collect()}
    assert names == {"REMA_BKG_S60-S90_W180-W150.nc4", "MERIT_S30-S60_W180-W150.nc4", "MERIT_N90-N60_E150-W180.nc4"}
    assert tiles.tile_grid(spark).count() == 288


def test_synthetic_terrain_and_cells(spark):
    drawn = sources.IDEAL_MODES
    assert len(drawn) == 22
    assert len({m[:2] for m in drawn}) == 22
    assert all((c == 0) != (s == 0) and not (k == 0 and m < 0) for k, m, c, s in drawn)
    planted = [(1, 2, 3.0, 0.0), (2, -1, 0.0, 4.0)]
    points, _ = sources.spectral_terrain(spark, 16, 16, planted)
    found = lsff.spectrum(lsff.rectangle_fit(points, modes.basis_columns(modes.mode_table(spark, 4, 6)), 16, 16, 0.0)).where("ampl > 1e-9").collect()
    assert sorted((r.m_i, r.m_j, round(r.a_cos, 6), round(r.a_sin, 6)) for r in found) == [(1, 2, 3.0, 0.0), (2, -1, 0.0, 4.0)]
    z = sources.cosine_ramp(spark, 5, 10.0).orderBy("i", "j").toPandas().z.values.reshape(5, 5)
    assert np.allclose(z, -5 * np.cos(np.add.outer(*[np.linspace(0, 2 * np.pi, 5)] * 2)))
    cells = sources.synthetic_cells(spark, 4.0, 2.0, ("mid", "upper"), 0.25).orderBy("cell_id").collect()
    assert [(c.kind, c.lat_verts, c.lon_verts) for c in cells] == [("mid", [0.25, 1.75, 0.25], [0.25, 2.0, 3.75]), ("upper", [1.75, 1.75, 0.25], [0.25, 3.75, 3.75])]


@pytest.fixture(scope="module")
def terrain(spark):
    rows = [(i, j, 10 + 0.1 * i, 20 + 0.1 * j, float(np.sin(i / 3) + np.cos(j / 2))) for i in range(24) for j in range(20)]
    cells = [(5, [10.6, 10.6, 11.8], [20.5, 21.3, 20.9]), (6, [10.4, 11.4, 11.4, 10.4], [20.3, 20.3, 21.1, 21.1])]
    return spark.createDataFrame(rows, "i int, j int, lat double, lon double, z double"), spark.createDataFrame(cells, "cell_id long, lat_verts array<double>, lon_verts array<double>")


def test_segments_are_filtered_tapered_and_masked(spark, terrain):
    raster, cells = terrain
    plain = segments.segment(raster, cells, filtered=False).toPandas()
    soft = segments.segment(raster, cells, rect=True).toPandas().sort_values(["cell_id", "i", "j"])
    rect = segments.segment(raster, cells, rect=True, filtered=False).toPandas().sort_values(["cell_id", "i", "j"])
    assert rect.inside.all()
    for c in (5, 6):
        own, part = rect[rect.cell_id == c], plain[plain.cell_id == c]
        assert abs(part[part.inside].z.mean()) < 1e-9
        assert 0.4 < part.inside.mean() < 0.75 if c == 5 else part.inside.all()
        shape = own.i.max() + 1, own.j.max() + 1
        z = fields.low_pass(own.z.values.reshape(shape), own.wlon.iloc[0], own.wlat.iloc[0])
        assert np.allclose(soft[soft.cell_id == c].z.values.reshape(shape), z - z.mean())
        assert own.y.max() == pytest.approx(own.wlat.iloc[0] * (shape[0] - 1))
        assert own.wlat.iloc[0] == pytest.approx(6_371_000 * np.radians(0.1))
    quad = segments.tapered_rectangles(raster, cells, 2, 30).toPandas()
    poly = segments.tapered_polygons(raster, cells, 2, 30).toPandas()
    for c in (5, 6):
        shape = tuple(rect[rect.cell_id == c][k].max() + 5 for k in "ij")
        assert all(len(x[x.cell_id == c]) == shape[0] * shape[1] for x in (quad, poly))
        p = poly[poly.cell_id == c]
        inside = np.pad(plain[plain.cell_id == c].sort_values(["i", "j"]).inside.values.reshape(shape[0] - 4, -1), 2)
        want = fields.taper(inside, 30) > 1e-2
        assert (p.sort_values(["i", "j"]).inside.values.reshape(shape) == want).all()
        assert abs(p[p.inside].z.mean()) < 1e-9
    assert segments.segment(raster, cells.limit(0)).count() == 0


def lattice_points(spark, shapes, seed=1):
    rng = np.random.default_rng(seed)
    z = {c: rng.standard_normal(shape).cumsum(0) for c, shape in shapes.items()}
    rows = [(c, i, j, float(v), 3.0 + c, 2.0) for c, f in z.items() for (i, j), v in np.ndenumerate(f)]
    return z, spark.createDataFrame(rows, "cell_id long, i int, j int, z double, wlat double, wlon double")


def as_field(rows, value, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        assert np.isnan(out[r.i, r.j])
        out[r.i, r.j] = r[value]
    return out


@pytest.mark.parametrize("run_values", [1, 40, 1 << 18])
def test_transforms_of_any_split_equal_the_kernels(spark, run_values):
    """Odd and even sides, single lines and single columns; from one column a run to all in one."""
    shapes = {1: (8, 8), 2: (13, 6), 3: (1, 9), 4: (7, 1), 5: (10, 15)}
    z, points = lattice_points(spark, shapes)
    got = lattices.low_passed(points, "wlat", "wlon", 11.0, run_values).collect()
    amplitudes = lattices.spectrum(points, run_values).collect()
    for c, shape in shapes.items():
        assert np.allclose(as_field([r for r in got if r.cell_id == c], "z", shape), fields.low_pass(z[c], 2.0, 3.0 + c, 11.0))
        want = fields.spectrum(z[c])
        own = {(r.l_idx, r.k_idx): r.ampl for r in amplitudes if r.cell_id == c}
        assert own.keys() == {k for k, _ in np.ndenumerate(want)}
        assert all(np.isclose(own[k], v) for k, v in np.ndenumerate(want))


def test_transforms_refuse_holes_and_take_empty_tables(spark):
    _, points = lattice_points(spark, {1: (4, 4)})
    with pytest.raises(Exception, match="not a whole lattice"):
        lattices.low_passed(points.where("i <> 2 or j <> 1"), 1.0, 1.0).collect()
    with pytest.raises(Exception, match="not a whole lattice"):
        lattices.spectrum(points.where("i <> 2")).collect()
    holed = lattices.low_passed(points.withColumn("z", F.when(F.col("i") + F.col("j") > 0, F.col("z"))), 1.0, 1.0).collect()
    assert len(holed) == 16 and all(math.isnan(r.z) for r in holed)
    none = points.where("i > 9")
    assert lattices.low_passed(none, 1.0, 1.0).count() == lattices.spectrum(none).count() == lattices.diffused(none.withColumn("inside", F.lit(True)), 1, 2).count() == 0


@pytest.mark.parametrize(("tile", "halo", "padding", "steps"), [(4, 3, 2, 10), (5, 5, 3, 7), (64, 16, 4, 20), (3, 1, 0, 5), (7, 2, 5, 0)])
def test_diffusion_in_tiles_equals_the_kernel(spark, tile, halo, padding, steps):
    rng = np.random.default_rng(tile)
    shapes = {1: (9, 12), 2: (4, 17), 3: (1, 1)}
    masks = {c: rng.random(shape) < 0.3 for c, shape in shapes.items()}
    rows = [(c, i, j, bool(v) or None) for c, m in masks.items() for (i, j), v in np.ndenumerate(m)]
    points = spark.createDataFrame(rows, "cell_id long, i int, j int, inside boolean")
    got = lattices.diffused(points.unionByName(points), padding, steps, "PK", 0.4, tile=tile, halo=halo).collect()
    for c, mask in masks.items():
        want = fields.taper(np.pad(mask, padding), steps, "PK", 0.4)
        assert np.allclose(as_field([r for r in got if r.cell_id == c], "p", want.shape), want)


def test_small_lattices_in_large_tiles_cost_their_own_nodes(spark):
    """Tiles end where the lattice ends: tiles of 4096 x 4096 nodes filled up would be 134 MB a lattice, and 3 billion rows here."""
    nodes = spark.range(200 * 30).selectExpr("id div 30 as cell_id", "cast(id % 30 div 6 as int) as i", "cast(id % 6 as int) as j", "id % 7 = id div 30 % 7 as inside")
    got = lattices.diffused(nodes, 1, 9, tile=4096, halo=16)
    assert got.count() == 200 * 7 * 8
    mask = np.zeros((5, 6), bool)
    for r in nodes.where("cell_id = 123 and inside").collect():
        mask[r.i, r.j] = True
    assert np.allclose(as_field(got.where("cell_id = 123").collect(), "p", (7, 8)), fields.taper(np.pad(mask, 1), 9))


def test_corner_and_centre_projections_differ(spark, terrain):
    raster, cells = terrain
    wide = [segments.segment(raster, cells, filtered=False, centre=c).groupBy("cell_id").agg(F.first("wlon").alias("w")).where("cell_id = 5").head().w for c in (True, False)]
    assert wide[0] == pytest.approx(6_371_000 * np.radians(0.1) * np.cos(np.radians(11.15)))
    assert wide[1] == pytest.approx(6_371_000 * np.radians(0.1) * np.cos(np.radians(10.6)))


def test_own_feature_checks(spark):
    points = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", -3.0)], "region string, z double")
    none = "cast(null as double)"
    regions = spark.createDataFrame([("a", "cave"), ("b", "ocean")], "region string, kind string").selectExpr("*", f"{none} level", f"{none} tolerance", f"{none} min_height", "0.8d min_water", "2d min_depth", f"{none} min_land")
    got = features.checked_features(points, regions, {"cave": lambda: F.col("low") > 4}).select("region", "passed", "level_share").collect()
    assert sorted(map(tuple, got)) == [("a", True, 0.0), ("b", True, 0.0)]


def test_batches_keep_to_their_budget(spark):
    cells = spark.createDataFrame([(k, float(lat)) for k, lat in enumerate([0, 10, 20, 61, 70, 75, 80, 84, 86, 89, 89, 30])], "cell_id long, lat double")
    got = sources.memory_batches(cells, 100.0).toPandas()
    gb = got.set_index("cell_id").gb
    order, batch, own = sorted(gb.index, key=lambda k: (-gb[k], k)), 0, []
    for k in order:
        if own and np.mean([*own, gb[k]]) * len(own) > 100:
            batch, own = batch + 1, []
        own.append(gb[k])
        assert got.set_index("cell_id").batch_id[k] == batch
    assert (got.n_workers * got.worker_gb <= 100 + 1e-9).all()
    assert (got.worker_gb <= 1.5 * gb.max()).all()


def test_angles_of_named_columns(spark):
    df = spark.createDataFrame([(3.141592653589793, [0.0, 1.5707963267948966], 7)], "a double, b array<double>, c int")
    assert tuple(rad2deg_columns(df, ["a", "b"]).head()) == (180.0, [0.0, 90.0], 7)


def test_settings_reject_nonsense():
    assert Settings().rect
    assert not Settings(cg_spsp=True).rect
    with pytest.raises(ValueError):
        Settings(n_modes=0)
    assert Settings(tag="a").name("etopo", "") == "a_etopo"


def test_variants_against_their_base(spark):
    rows = [("base", 1, 0, -4.0), ("base", 1, 1, 2.0), ("iso", 1, 0, -3.0), ("iso", 1, 1, 0.0), ("base", 2, 0, 0.0), ("iso", 2, 0, 0.5)]
    df = spark.createDataFrame(rows, "variant string, cell_id int, k int, uw double")
    assert {tuple(r) for r in diagnostics.flux_differences(df, "uw", "base", ("k",)).collect()} == {("iso", 1, 0.5), ("iso", 2, 0.5)}
    err = spark.createDataFrame([("base", 1, 8.0), ("iso", 1, 6.0), ("sel", 1, 10.0), ("base", 2, 0.0), ("iso", 2, 1.0)], "variant string, cell_id int, e double")
    assert {tuple(r) for r in diagnostics.improvements(err, "e", "base").collect()} == {("iso", 1, 25.0), ("sel", 1, -25.0), ("iso", 2, None)}


def test_stream_equals_batch(spark):
    source = shared_path(spark, "stream")
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(source)
    want = {r.window.start: (r.n, round(r.a_cos, 6)) for r in windowed_fit(events).collect()}
    stream = windowed_fit(spark.readStream.schema(events.schema).parquet(source))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("fits").option("checkpointLocation", shared_path(spark, "cp")).start()
    q.processAllAvailable()
    got = {r.window.start: (r.n, round(r.a_cos, 6)) for r in spark.table("fits").collect()}
    q.stop()
    assert got == want


# fixed values: the published run's reference amplitude of every mode of IDEAL_MODES, whether that is a cosine or a sine
IDEAL_AMPLITUDES = [
    81.28171453820204, 8.433014164350961, 62.212303671313265, 81.65688208929055, 90.22220430515803, 51.660236062744026,
    53.61814744463018, 77.76528195442526, 29.2481278822855, 96.5044479545187, 50.77976418220279, 6.986520582162603,
    59.80104622085892, 94.12924911884826, 87.81493341343514, 56.98774143448841, 25.29144444707756, 96.55853709675661,
    30.252052368472228, 3.8030910076267133, 67.5806309651723, 30.709303190516124,
]


def test_idealised_experiment(spark):
    """The published figures of the idealised triangle: amplitude errors of the regularised fit and of refits with all 22 modes and with 14.

    Indices are the ceilings of quotients on metres, as the published run has them, and the numbers of lines those of the points in use.
    """
    drawn = sources.IDEAL_MODES
    true = np.zeros((12, 12))
    for (a, b, *_), size in zip(drawn, IDEAL_AMPLITUDES, strict=True):
        true[b + 5, a] = size
    x = np.linspace(0, 2 * np.pi, 480)
    at = np.ceil(x / np.diff(x).mean()).astype(int)
    z = sum(c * np.cos(a * x[None, :] + b * x[:, None]) + s * np.sin(a * x[None, :] + b * x[:, None]) for a, b, c, s in drawn)
    column, row = np.meshgrid(np.arange(480), np.arange(480))
    frame = pd.DataFrame({"cell_id": 0, "i": at[column.ravel()], "j": at[row.ravel()], "ux": (x / x.max())[column.ravel()], "uy": (x / x.max())[row.ravel()], "z": z.ravel()})
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    points = spark.createDataFrame(frame).withColumn("inside", geo.in_polygon("ux", "uy", [(0.0, 0.0), (0.5, 1.0), (1.0, 0.0)])).cache()
    spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    inside = R.demeaned(points.where("inside").select("cell_id", "i", "j", "z"))
    every = points.select("cell_id").limit(1).crossJoin(modes.mode_table(spark, 12, 12).where("not (m_i = 0 and m_j < 0)"))
    lines = points.where("inside").agg(F.count_distinct("ux"), F.count_distinct("uy")).head()
    assert tuple(lines) == (480, 479)

    def grid(fit):
        out = np.zeros((12, 12))
        for r in fit.collect():
            out[r.l_idx, r.k_idx] = r.ampl
        return out

    def figures(fit):
        got = grid(fit)
        return float(np.linalg.norm(got - true)), abs(got.sum() - true.sum()) / true.sum() * 100

    error, off = figures(fits.refit(inside, every, *lines, 8e-5))
    assert (error, off) == (pytest.approx(115.713, rel=1e-3), pytest.approx(49.737, rel=5e-3))
    first = fits.refit(R.demeaned(points.select("cell_id", "i", "j", "z")), every, 480, 480, 0.1).persist()
    for n, want in ((22, (85.677, 0.002)), (14, (111.372, 7.759))):
        error, off = figures(fits.refit(inside, modes.top_modes(first, n), *lines, 1e-6))
        assert (error, off) == (pytest.approx(want[0], rel=2e-4), pytest.approx(want[1], abs=5e-3))
    points.unpersist()
    first.unpersist()


def test_windows_of_any_size_equal_their_nodes(spark):
    rng = np.random.default_rng(2)
    z = {c: rng.standard_normal((9, 13)) for c in (1, 2)}
    z[2][4, 5] = np.nan
    rows = [(c, i, j, None if np.isnan(v) else float(v)) for c, f in z.items() for (i, j), v in np.ndenumerate(f)]
    points = spark.createDataFrame(rows, "cell_id long, i int, j int, z double")
    for hi, hj, si, sj in ((1, 1, 1, 1), (3, 4, 2, 3), (9, 13, 5, 5), (10, 2, 1, 1)):
        got = {(r.cell_id, r.i, r.j): r.z for r in R.window_means(points, hi, hj, si, sj, keys=("cell_id",)).collect()}
        want = {(c, i, j): f[i : i + hi, j : j + hj].mean() for c, f in z.items() for i in range(0, 10 - hi, si) for j in range(0, 14 - hj, sj)}
        want = {k: v for k, v in want.items() if not np.isnan(v)}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(v) for k, v in want.items())
    with pytest.raises(ValueError, match="at least one"):
        R.window_means(points, 0, 1)
    assert R.window_means(points.where("i > 99"), 2, 2, keys=("cell_id",)).count() == 0


def test_a_range_of_records_opens_its_chunks_only(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("cell_id"), (F.col("id") * 2.0).alias("recon"))
    path = sinks.write_chunks(rows, f"file://{tmp_path}/records")
    part = sinks.read_range(spark, path, 250, 403)
    assert sorted(r.cell_id for r in part.collect()) == list(range(250, 403))
    assert part.columns == ["cell_id", "recon"]
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in scan and "PushedFilters: [IsNotNull(cell_id)" in scan
    assert len({f.split("chunk=")[1].split("/")[0] for f in spark.read.parquet(path).where("chunk between 2 and 4").inputFiles()}) >= 3
    assert sinks.read_range(spark, path, 999, 1000).head().recon == 1998.0
    assert sinks.read_range(spark, path, 5000, 6000).count() == sinks.read_range(spark, path, 7, 7).count() == 0
    with pytest.raises(Exception, match="no id"):
        sinks.write_chunks(spark.createDataFrame([(None, 1.0)], "cell_id long, recon double"), f"file://{tmp_path}/none")


def test_large_tables_have_few_folders(spark, tmp_path, monkeypatch):
    """Folders of many chunks past a number of them; ranges of ids, far ones too, still come out whole."""
    monkeypatch.setattr(sinks, "FOLDERS", 10)
    ids = spark.range(3000).unionByName(spark.createDataFrame([(10**15,)], "id long"))
    rows = ids.select(F.col("id").alias("cell_id"), (F.col("id") * 2.0).alias("recon"))
    path = sinks.write_chunks(rows, f"file://{tmp_path}/records")
    folders = {f.rsplit("/", 1)[0] for f in spark.read.parquet(path).inputFiles()}
    assert 3 <= len(folders) <= 10
    part = sinks.read_range(spark, path, 250, 1903)
    assert sorted(r.cell_id for r in part.collect()) == list(range(250, 1903)) and part.columns == ["cell_id", "recon"]
    assert "PartitionFilters: [isnotnull(chunk" in part._jdf.queryExecution().executedPlan().toString()
    assert [r.recon for r in sinks.read_range(spark, path, 10**15, 10**15 + 1).collect()] == [2e15]
    some = sinks.write_chunks(rows.unionByName(spark.createDataFrame([(None, 7.0)], "cell_id long, recon double")), f"file://{tmp_path}/nulls", nulls=True)
    assert spark.read.parquet(some).count() == 3002 and spark.read.parquet(some).where("cell_id is null").head().recon == 7.0


def test_appends_of_large_tables_have_few_folders(spark, tmp_path, monkeypatch):
    """Appends of different spans of chunks meet each other's records."""
    monkeypatch.setattr(sinks, "FOLDERS", 10)
    ids = spark.range(3000).unionByName(spark.createDataFrame([(10**10,)], "id long"))
    whole = ids.selectExpr("id as cell_id", "0 as is_land", "1.0 as clat", "double(id) as clon", "double(null) as dk", "double(null) as dl", "array(double(0)) as h_spec")
    table = f"file://{tmp_path}/table"
    assert sinks.append_missing(whole.where("cell_id between 950 and 1100"), table).count() == 151
    assert sinks.append_missing(whole.where("cell_id < 2900"), table).count() == 2900
    got = sinks.append_missing(whole, table)
    assert len({f.rsplit("/", 1)[0] for f in spark.read.parquet(table).inputFiles()}) <= 20
    assert got.select("cell_id").distinct().count() == got.count() == 3001
    assert got.where("chunk <> cell_id div 100 and cell_id < 3000").count() == 0 and got.columns[-1] == "chunk"
