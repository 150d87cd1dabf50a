import duckdb
import numpy as np
import pytest

from pluvion.functions import linalg as L
from pluvion.functions import scalar as S


def duck(expr):
    return duckdb.sql(f"SELECT {expr}").fetchall()[0][0]


def test_kernels_at_two_bandwidths():
    for name in S.KERNELS:
        w = float(L.kernel_weights(np.array([2.0]), 1.0, name)[0])
        assert (w > 0) == (name in ("gaussian", "exponential"))
        assert duck(S.kernel(name, "2e0", "1e0")) == pytest.approx(w)
        assert float(L.kernel_weights(np.array([2.0]), np.inf, name)[0]) == 1.0
        assert duck(S.kernel(name, "2e0", "CAST(NULL AS DOUBLE)")) == 1.0
    assert [float(L.kernel_weights(np.array([1.0]), 1.0, n)[0]) for n in ("bisquare", "tricube", "boxcar")] == [0, 0, 1]


def test_haversine_agrees():
    a = L.haversine_km(np.array([[110.0, 31.0]]), np.array([[111.0, 32.0]]))[0, 0]
    assert duck(S.haversine("110e0", "31e0", "111e0", "32e0")) == pytest.approx(a)


def test_intensity_classes():
    values = [0, 0.09, 0.1, 1.99, 2, 3.99, 4, 8, 19.99, 20, 150]
    assert [duck(S.classed(S.num(v), S.INTENSITY_EDGES)) for v in values] == [0, 0, 1, 1, 2, 2, 3, 4, 4, 5, 5]
    assert duck(S.classed("CAST(NULL AS DOUBLE)", S.INTENSITY_EDGES)) == -1


def test_spline_reproduces_a_plane_and_refuses_a_line():
    r = np.random.default_rng(1)
    p = np.column_stack([110 + r.random(12), 31 + r.random(12)])
    y = 2 + 0.3 * p[:, 0] - 0.7 * p[:, 1]
    t = np.column_stack([110 + r.random(5), 31 + r.random(5)])
    assert np.abs(L.tps_predict(p, y, t, 1e-9) - (2 + 0.3 * t[:, 0] - 0.7 * t[:, 1])).max() < 1e-4
    line = np.column_stack([np.full(5, 110.0), 31 + np.arange(5.0)])
    assert np.isnan(L.tps_predict(line, np.arange(5.0), t)).all()


def test_spline_left_out_equals_refits():
    r = np.random.default_rng(2)
    p, y = np.column_stack([110 + r.random(9), 31 + r.random(9)]), r.random(9)
    xy = L.local_km(p)
    k = L.tps_kernel(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    scale = float(np.median(np.abs(k[k != 0])))
    loo = L.tps_loo(p, y, 0.1)
    for i in range(9):
        rest = np.arange(9) != i
        centre = p.mean(axis=0)
        a = L._tps_system(L.local_km(p[rest], centre), 0.1, scale)
        w = np.linalg.solve(a, np.concatenate([y[rest], np.zeros(3)]))
        at = L.local_km(p[i : i + 1], centre)
        assert loo[i] == pytest.approx(float((np.column_stack([L.tps_kernel(((at[:, None] - L.local_km(p[rest], centre)[None]) ** 2).sum(axis=2)), np.ones(1), at]) @ w)[0]), abs=1e-8)


def test_mixed_and_multiscale_recover_constant_coefficients():
    r = np.random.default_rng(3)
    n = 60
    p = np.column_stack([110 + r.random(n), 31 + r.random(n)])
    a, b = r.random(n), r.random(n)
    y = 1 + 2 * a + 3 * b
    local, fixed = np.column_stack([np.ones(n), a]), b[:, None]
    pred = L.mixed_gwr(p[:50], y[:50], local[:50], fixed[:50], 30, p[50:], local[50:], fixed[50:])
    assert np.abs(pred - y[50:]).max() < 0.05
    groups = [np.ones((n, 1)), a[:, None], b[:, None]]
    pred = L.multiscale_gwr(p[:50], y[:50], [g[:50] for g in groups], [49, 49, 49], p[50:], [g[50:] for g in groups])
    assert np.abs(pred - y[50:]).max() < 0.1


def test_nnls_and_inflation():
    r = np.random.default_rng(4)
    x = r.random((200, 3))
    y = x @ np.array([0.25, 0.0, 0.6])
    w = L.nnls(x.T @ x, x.T @ y, float(y @ y))
    assert np.abs(w - [0.25, 0, 0.6]).max() < 1e-8
    y2 = x @ np.array([0.5, -1.0, 0.2])
    assert (L.nnls(x.T @ x, x.T @ y2, float(y2 @ y2)) >= 0).all()
    z = np.column_stack([x[:, 0], x[:, 0] + 1e-3 * r.random(200), x[:, 2]])
    assert L.vif(z)[0] > 100 and len(L.prune_by_vif(z, np.array([0.1, 0.2, 0.3]))) == 2


def test_hilbert_folds_are_balanced_and_fixed():
    r = np.random.default_rng(5)
    p = np.column_stack([110 + r.random(23), 31 + r.random(23)])
    f = L.hilbert_folds(list(range(23)), p, 5)
    assert sorted(np.bincount(f)[1:].tolist()) == [4, 4, 5, 5, 5]
    assert (f == L.hilbert_folds(list(range(23)), p, 5)).all()
    for order in (1, 3, 5):  # every cell once, each next to the one before, corner to corner
        side = 1 << order
        x, y = (v.ravel() for v in np.meshgrid(np.arange(side), np.arange(side)))
        place = L.hilbert_index(x, y, order)
        assert sorted(place.tolist()) == list(range(side * side))
        at = np.argsort(place)
        assert (np.abs(np.diff(x[at])) + np.abs(np.diff(y[at])) == 1).all()
        assert (x[at[0]], y[at[0]], x[at[-1]], y[at[-1]]) == (0, 0, side - 1, 0)


def test_local_hats_by_brute_force():
    r = np.random.default_rng(6)
    place, x = r.random((14, 2)), np.column_stack([np.ones(14), r.random(14)])
    d = L.haversine_km(place, place)
    hat = L.local_hat(x, x, d, 6, "bisquare", True, 1e-6, True)
    for t in range(14):
        others = np.delete(d[t], t)
        w = L.kernel_weights(d[t], np.sort(others)[5])
        w[t] = 0
        a = (x * w[:, None]).T @ x + 1e-6 * np.eye(2)
        assert np.allclose(hat[t], np.linalg.solve(a, x[t]) @ (x * w[:, None]).T)


def test_spline_of_bad_networks_is_missing():
    line = np.column_stack([np.linspace(110, 111, 4), np.linspace(31, 32, 4)])
    bent = line + np.array([[0, 0], [0, 1e-9], [0, 0], [0, 0]])
    for place in (line, bent, np.repeat([[110.0, 31.0]], 5, axis=0), line[:2]):
        n = len(place)
        assert np.isnan(L.tps_predict(place, np.arange(n, dtype=float), place[:1] + 0.1)).all() and np.isnan(L.tps_loo(place, np.arange(n, dtype=float))).all()


def test_bootstrap_and_permutation():
    sums = np.column_stack([np.full(40, 10.0), np.full(40, 5.0), np.full(40, 9.0)])
    out = L.block_bootstrap(sums, lambda s: np.sqrt(s[2] / s[0]) - np.sqrt(s[1] / s[0]), 200)
    assert out["low"] > 0 and out["p"] == 0.0
    x = np.arange(30.0)
    assert L.permutation_pvalue(lambda a, b: np.corrcoef(a, b)[0, 1], x, x, 99) == pytest.approx(0.01)


def test_calibration_of_global_weights_is_least_squares():
    r = np.random.default_rng(6)
    x = np.column_stack([np.ones(30), r.random(30)])
    y = x @ [1.0, 2.0] + 0.1 * r.standard_normal(30)
    out = L.gwr_calibrate(x, y, np.ones((30, 30)))
    assert out["trace"] == pytest.approx(2, abs=1e-5)
    assert np.abs(out["beta"] - np.linalg.lstsq(x, y, rcond=None)[0]).max() < 1e-6


def test_slopes_that_vary_are_seen():
    r = np.random.default_rng(7)
    p = np.column_stack([110 + r.random(120), 31 + r.random(120)])
    x = r.standard_normal(120)
    varying, fixed = x * (p[:, 0] - 110.5) * 4, 2 * x + 0.1 * r.standard_normal(120)
    share = lambda y: np.mean([L.slope_variance(p[r.permutation(120)], x, y) >= L.slope_variance(p, x, y) for _ in range(39)])
    assert share(varying) == 0 and share(fixed) > 0.02
