"""Kernels against identities, planted answers and brute force."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orogrid.kernels import fields, linear


def planted(n=200, m=30, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, m))
    a /= np.linalg.norm(a, axis=0)
    y = 5 * a[:, 3] - 4 * a[:, 11 % m] + 3 * a[:, 22 % m] + 0.001 * rng.standard_normal(n)
    return a, y


def test_selectors_recover_planted_columns():
    a, y = planted()
    s = linear.System.of(a, y)
    assert set(linear.omp(s, 3)) == {3, 11, 22}
    assert set(linear.omp(s, 3, batch=3)) == {3, 11, 22}
    assert set(linear.lasso(s, 3)) == {3, 11, 22}
    assert set(linear.omp(s, 2, offset=4)) == set(linear.lasso(s, 2, offset=4)) == {11, 22}
    assert len(linear.omp(s, 99)) == 30


def test_selectors_on_sums_equal_those_on_points():
    """Matching pursuit and lasso by their definitions, on residuals of points."""
    a, y = planted(90, 12, 5)
    y = y + 0.5 * np.random.default_rng(2).standard_normal(90)
    chosen, left = [], y
    for _ in range(5):
        c = np.abs(a.T @ left) / np.linalg.norm(a, axis=0)
        c[chosen] = -1
        chosen.append(int(np.argmax(c)))
        left = y - a[:, chosen] @ np.linalg.lstsq(a[:, chosen], y, rcond=None)[0]
    assert linear.omp(linear.System.of(a, y), 5).tolist() == chosen
    w, alpha = np.zeros(12), 1e-3 * np.abs(a.T @ y).max() / 90
    for _ in range(500):
        for c in range(12):
            r = a[:, c] @ (y - a @ w) + (a[:, c] @ a[:, c]) * w[c]
            w[c] = np.sign(r) * max(abs(r) - alpha * 90, 0) / (a[:, c] @ a[:, c])
    assert linear.lasso(linear.System.of(a, y), 4).tolist() == np.argsort(-np.abs(w), kind="stable")[:4].tolist()


def test_zero_exponent_is_isotropic():
    a, y = planted()
    g = a.T @ a
    k = np.arange(30.0)
    assert np.allclose(linear.spectral(g, 0.3, k, 0.0), linear.isotropic(g, 0.3))
    assert linear.isotropic(g, 0.0).sum() == 0
    assert np.all(np.diff(linear.spectral(g, 0.3, k, 2.0)) > 0)
    s = linear.System.of(a, y)
    assert linear.joint_gcv(s, k, alphas=(0.0,))[1:] == pytest.approx(linear.gcv(s))


def test_gcv_equals_direct_formula():
    a, y = planted(80, 15)
    a = a * 3  # mean diagonal 9
    for lam in (1e-4, 0.1, 3.0):
        hat = a @ np.linalg.solve(a.T @ a + 9 * lam * np.eye(15), a.T)
        r = y - hat @ y
        assert linear.gcv(linear.System.of(a, y), grid=np.array([lam]))[1] == pytest.approx(r @ r / (80 - np.trace(hat)) ** 2, rel=1e-6)


def test_a_chosen_penalty_is_one_that_a_fit_takes():
    """The score of the chosen lambda, handed to the fit's own penalty and solve, is that of the selector."""
    a, y = planted(80, 15)
    a, s = a * 3, linear.System.of(a * 3, y)
    lam, score = linear.gcv(s)
    w = linear.solve(s.gram, s.rhs, linear.isotropic(s.gram, lam))
    free = 80 - np.trace(a @ np.linalg.solve(s.gram + np.diag(linear.isotropic(s.gram, lam)), a.T))
    assert s.error(w) * 80 / free**2 == pytest.approx(score)
    assert all(linear.gcv(s, grid=np.array([g]))[1] >= score for g in linear.lambda_grid(s.gram))


def test_marginal_likelihood_is_a_fixed_point():
    a, y = planted(120, 10)
    a, y = a * 2, y + 0.3 * np.random.default_rng(1).standard_normal(120)
    lam = 4 * linear.marginal_likelihood(linear.System.of(a, y))  # back from multiples of the mean diagonal
    w = np.linalg.solve(a.T @ a + lam * np.eye(10), a.T @ y)
    d = np.linalg.eigvalsh(a.T @ a)
    gamma = (d / (d + lam)).sum()
    assert gamma / (w @ w) * ((y - a @ w) @ (y - a @ w)) / (120 - gamma) == pytest.approx(lam, rel=1e-3)


def test_folds_are_disjoint_and_buffered():
    x, y = (v.ravel().astype(float) for v in np.meshgrid(np.arange(20), np.arange(15)))
    sets = linear.folds(x, y, 6, 0.2, seed=1)
    assert len(sets) == 6
    assert sum(h.astype(int) for _, h in sets).max() == 1
    assert all(not (t & h).any() for t, h in sets)
    assert [h.tolist() for _, h in sets] != [h.tolist() for _, h in linear.folds(x, y, 6, 0.2, seed=2)]
    with pytest.raises(ValueError, match="extent"):
        linear.folds(x, np.zeros_like(y), 4, 0.1)
    with pytest.raises(ValueError, match="too few"):
        linear.folds(x[:7], y[:7], 4, 0.1)
    corner = (x < 3) & (y < 3)
    with pytest.raises(ValueError, match="no points"):
        linear.folds(np.append(x[corner], 19.0), np.append(y[corner], 14.0), 4, 0.1, seed=0)


def test_tiles_are_near_square():
    for box, n, shape in ((((0, 10), (0, 10)), 4, (2, 2)), (((0, 40), (0, 10)), 5, (5, 1)), (((0, 10), (0, 90)), 4, (1, 4)), (((0, 10), (0, 10)), 7, (3, 3)), (((0, 3), (0, 1)), 1, (1, 1))):
        t = linear.Tiling.drawn(*box, n, 0)
        assert (t.across, t.down) == shape
        assert sorted(f for f in t.fold if f >= 0) == list(range(n))
        assert t.wide * t.across == pytest.approx(box[0][1] - box[0][0])
        assert t.high * t.down == pytest.approx(box[1][1] - box[1][0])


def test_members_are_those_within_the_tile_and_its_buffer():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 10, 500), rng.uniform(0, 7, 500)
    x[:3], y[:3] = (0, 10, 5), (7, 0, 3.5)
    for n, buffer in ((4, 0.0), (5, 0.25), (3, 1.5)):
        t = linear.Tiling.drawn((0, 10), (0, 7), n, 1)
        got = t.members(x, y, buffer)
        for number, fold in enumerate(t.fold):
            if fold >= 0:
                low, left = (number // t.across) * t.high, (number % t.across) * t.wide
                near = (x >= left - buffer * t.wide) & (x < left + (1 + buffer) * t.wide) & (y >= low - buffer * t.high) & (y < low + (1 + buffer) * t.high)
                assert (got[fold] == near).all()


def test_fold_errors_equal_single_fits():
    a, y = planted(90, 12)
    train, held = linear.System.of(a[:60], y[:60]), linear.System.of(a[60:], y[60:])
    grid = np.logspace(-6, 2, 9)
    for weights in (linear.isotropic(train.gram, 1.0), linear.spectral(train.gram, 1.0, np.arange(12.0), 1.5)):
        want = [np.mean((y[60:] - a[60:] @ np.linalg.solve(train.gram + np.diag(g * weights), train.rhs)) ** 2) for g in grid]
        assert np.allclose(linear.fold_errors(train, held, weights, grid), want)


def test_heavier_penalty_has_larger_held_out_error():
    i, j = (v.ravel().astype(float) for v in np.meshgrid(np.arange(15), np.arange(15)))
    m = linear.basis(i, j, np.array([0, 1, 2]), np.array([0, 1, 1]), 15, 15)
    y = m @ np.ones(m.shape[1])
    light, heavy = (linear.spatial_cv_points(m, y, i, j, 4, seed=0, grid=np.array([g]))[1] for g in (1e-6, 1e4))
    assert light < heavy


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 50))
def test_low_pass_is_mean_free_and_smoother(a, b, seed):
    z = np.random.default_rng(seed).standard_normal((a, b))
    out = fields.low_pass(z, 1000.0, 1000.0)
    assert abs(out.mean()) < 1e-9
    assert np.var(out) <= np.var(z) + 1e-9


def test_taper_keeps_the_inside_and_decays():
    inside = np.pad(np.ones((4, 4), bool), 6)
    p = fields.taper(inside, 30)
    assert (p[inside] == 1).all()
    assert 0 < p[4, 8] < 1
    assert p[0, 0] < p[4, 4]


@pytest.mark.parametrize(("name", "gamma"), [("OP", 0.5), ("5pt", 0.0), ("PK", 1 / 3)])
def test_taper_equals_the_stencil(name, gamma):
    stencil = np.array([[gamma / 2, 1 - gamma, gamma / 2], [1 - gamma, -4 * (1 - gamma) - 2 * gamma, 1 - gamma], [gamma / 2, 1 - gamma, gamma / 2]])
    inside = np.zeros((9, 12), bool)
    inside[3:6, 4:9] = True
    p = inside.astype(float)
    for _ in range(20):
        q, new = np.pad(p, 1), p.copy()
        for a in range(9):
            for b in range(12):
                new[a, b] += 0.5 * (stencil * q[a : a + 3, b : b + 3]).sum()
        new[inside] = 1
        p = new
    assert np.allclose(fields.taper(inside, 20, name), p)


def test_synthetic_fields():
    z = fields.diffused_noise((16, 16), 5, 100)
    assert z.min() == -1
    assert z.max() == pytest.approx(1)
    start = np.random.default_rng(5).random((16, 16))  # periodic diffusion multiplies each wave by a power of its own factor
    k = 2 * np.cos(2 * np.pi * np.arange(16) / 16) - 2
    want = np.fft.ifft2(np.fft.fft2(start) * (1 + 0.1 * (k[:, None] + k[None, :])) ** 100).real
    assert np.allclose(z, 2 * (want - want.min()) / np.ptp(want) - 1)
    f = fields.power_law(64, 2.0, 7)
    power, freq = np.abs(np.fft.fft2(f)) ** 2, np.hypot(*np.meshgrid(np.fft.fftfreq(64), np.fft.fftfreq(64)))
    near = (freq > 0.02) & (freq < 0.2)
    assert np.polyfit(np.log(freq[near]), np.log(power[near]), 1)[0] == pytest.approx(-2.0, abs=0.5)


def test_lassos_equal_the_lasso_of_each_system():
    """Side by side and one by one, to the last bit; converged systems, empty columns and other sizes too. A few hundred take less time than a few would one by one."""
    rng = np.random.default_rng(4)
    made = lambda k, rows, columns: linear.System.of(rng.standard_normal((rows, columns)) * (np.arange(columns) != k % 5), rng.standard_normal(rows))
    some = [made(k, 9 + k, 12) for k in range(9)] + [made(1, 4, 7), made(2, 60, 1), linear.System(np.zeros((3, 3)), np.zeros(3), 0.0, 0)]
    for offset in (0, 1):
        assert [x.tolist() for x in linear.lassos(some, 5, offset=offset)] == [linear.lasso(s, 5, offset=offset).tolist() for s in some]
    own = linear._descended(some[:9], 500, 0)
    assert all(np.array_equal(np.argsort(-np.abs(own[:, k]), kind="stable"), linear.lasso(s, 12)) for k, s in enumerate(some[:9]))
    assert linear.lassos([], 3) == []
    began = time.process_time()
    few = [linear.lasso(made(7, 20, 29), 5) for _ in range(3)]
    middle = time.process_time()
    linear.lassos([made(7, 20, 29) for _ in range(150)], 5)
    assert len(few) == 3 and (time.process_time() - middle) < 10 * (middle - began)
