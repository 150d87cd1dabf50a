"""Regression kernels, folds and single-time predictors against plain loops and closed forms."""

import numpy as np
import pandas as pd
import pytest

from pluvion.functions import linalg as L
from pluvion.functions import regression as G
from pluvion.operators import benchmark as B
from pluvion.operators import hurdle as H
from pluvion.operators import joint as J

R = np.random.default_rng(11)
PLACE = np.column_stack([110 + R.random(24), 31 + R.random(24)])


def test_coefficient_forms_agree():
    x, y = np.column_stack([np.ones(24), R.random((24, 2))]), R.random((24, 5))
    w = R.random((7, 24))
    beta = G.gwr_coefficients(x, y, w)
    for t in range(7):
        for k in range(5):
            for solve in (L.solve_weighted, G.solve_inverse, G.solve_cholesky):
                assert np.allclose(beta[t, :, k], solve(x, y[:, k], w[t]))
        assert np.allclose(G.calibration_parts(x, y[:, 0], w[t])[0], beta[t, :, 0])
    assert np.allclose(G.gwr_coefficients(x, y[:, 0], w), beta[:, :, 0])
    at = x[:7]
    assert np.allclose(G.st_gwr(x, y, w, at), [[at[t] @ beta[t, :, k] for k in range(5)] for t in range(7)])
    few = G.top_weights(w, 8)
    assert ((few > 0).sum(axis=1) == 8).all() and np.allclose(G.st_gwr(x, y, w, at, 8), G.st_gwr(x, y, few, at))
    assert np.allclose(G.fitted(at, beta[:, :, 0]), (at * beta[:, :, 0]).sum(axis=1))


def test_bandwidth_rules():
    d = np.array([[0.0, 1.0, 2.0, 4.0], [0.0, 0.0, 0.0, 3.0]])
    assert G.width_plain(d, 3).tolist() == [2.0, 0.0] and G.width_plain(d, 8).tolist() == [8.0, 6.0]
    assert G.width_finite(d, 2.6).tolist() == [2.0, 3.0] and G.width_finite(d, 1).tolist() == [1.0, 3.0]
    assert G.width_finite(np.array([[0.0, np.inf], [0.0, 0.0]]), 2).tolist() == [1.0, 1.0]
    w = G.weights_panel(d, 3)
    assert w[0].tolist() == [1.0, 0.5625, 0.0, 0.0] and w[1].tolist() == [1.0, 1.0, 1.0, 0.0]
    square = np.array([[0.0, 1.0, 2.0], [1.0, 0.0, 1.0], [2.0, 1.0, 0.0]])
    assert np.diag(G.weights_panel(square, 2, True)).tolist() == [0, 0, 0]
    assert G.weights_hurdle(d[0], 2).tolist() == [1.0, 0.0, 0.0, 0.0] and G.weights_hurdle(d[0], 2.0, False, "boxcar").tolist() == [1, 1, 1, 0]
    with pytest.raises(ValueError):
        G.weights_hurdle(np.array([1.0, np.inf]), 2)


def test_ridge_leave_one_out_equals_refits():
    x, y = R.random((15, 3)), R.random(15)
    got = G.global_ridge(x, y, x, 0.1, True)
    want = [x[i] @ np.linalg.solve(np.delete(x, i, 0).T @ np.delete(x, i, 0) + 0.1 * np.eye(3), np.delete(x, i, 0).T @ np.delete(y, i)) for i in range(15)]
    assert np.allclose(got, want)
    assert G.global_ridge(np.zeros((4, 0)), y[:4], np.zeros((2, 0)), 0.1).tolist() == [0, 0]
    errors = [(y[i] - x[i] @ np.linalg.solve(np.delete(x, i, 0).T @ np.delete(x, i, 0) + 1e-8 * np.eye(3), np.delete(x, i, 0).T @ np.delete(y, i))) ** 2 for i in range(15)]
    assert G.loo_rmse(x, y) == pytest.approx(np.sqrt(np.mean(errors)))
    w = G.weights_panel(L.haversine_km(PLACE, PLACE), 10)
    xx = np.column_stack([np.ones(24), PLACE[:, 0] - 110])
    yy = 2 + 3 * xx[:, 1]
    yy[3] = np.nan
    assert np.allclose(G.local_ridge(xx, yy, xx, w, 1e-9), 2 + 3 * xx[:, 1], atol=1e-3)


def test_interpolators_by_plain_loops():
    y = R.random(24)
    for target, same in ((PLACE + 0.01, False), (PLACE, True)):
        d = L.haversine_km(target, PLACE)
        for k in (None, 5):
            want, turned = [], []
            for t in range(24):
                order = [i for i in np.argsort(d[t]) if not (same and i == t)][: k or 24]
                b = d[t][order] ** -2.0
                want.append((b * y[order]).sum() / b.sum())
                u = L.local_km(PLACE[order], target[t])
                u = u / np.linalg.norm(u, axis=1)[:, None]
                w = [b[i] * (1 + sum(b[j] * (1 - u[i] @ u[j]) for j in range(len(b)) if j != i) / (b.sum() - b[i])) for i in range(len(b))]
                turned.append((w * y[order]).sum() / np.sum(w))
            assert np.allclose(G.idw(PLACE, y, target, 2.0, k, same), want)
            assert np.allclose(G.adw(PLACE, y, target, 2.0, k, same), turned, rtol=1e-2 if k is None else 5e-2)
    assert G.idw(PLACE, y, PLACE[:3]).tolist() == y[:3].tolist()
    plane = 4 + 2 * (PLACE[:, 0] - 110) - (PLACE[:, 1] - 31)
    assert np.allclose(G.gwr(PLACE, plane, PLACE, "bisquare", True, 12, True), plane, atol=1e-4)
    assert np.isnan(G.gwr(PLACE[:2], plane[:2], PLACE[:1], bw=2)).all()


def test_mixed_and_damped_recover_constant_coefficients():
    a, b = R.random(24), R.random(24)
    y = 1 + 2 * a + 3 * b
    one, fixed = np.column_stack([np.ones(24), a]), b[:, None]
    at = np.column_stack([np.ones(3), [0.2, 0.5, 0.7]]), np.array([[0.1], [0.4], [0.9]])
    want = 1 + 2 * at[0][:, 1] + 3 * at[1][:, 0]
    assert np.allclose(G.mixed(y, PLACE, one, fixed, PLACE[:3] + 0.05, *at, 20, tol=1e-12, most=5000), want, atol=0.05)
    got = G.damped(y, PLACE, [one[:, :1], one[:, 1:]], fixed, PLACE[:3] + 0.05, [at[0][:, :1], at[0][:, 1:]], at[1], [23, 23], tol=1e-10)
    assert np.allclose(got, want, atol=0.1)
    left = G.mixed(y, PLACE, one, np.zeros((24, 0)), PLACE, one, np.zeros((24, 0)), 20, loo=True)
    assert left.shape == (24,) and np.isfinite(left).all()


def test_balanced_folds():
    for k in (2, 5, 7):
        for farthest in (False, True):
            f = G.balanced_folds(PLACE, k, 3, farthest)
            assert set(f) == set(range(1, k + 1)) and np.ptp(np.bincount(f)[1:]) <= 1 and (f == G.balanced_folds(PLACE, k, 3, farthest)).all()
    xy = L.local_km(PLACE)
    own = G.balanced_folds(PLACE, 4, 1)
    spread = lambda f: sum(((xy[f == i] - xy[f == i].mean(axis=0)) ** 2).sum() for i in range(1, 5))
    assert spread(own) < spread(R.permutation(own))
    assert G.weighted_draw(np.random.default_rng(0), np.array([0.0, 1.0, 0.0])) == 1


def test_shuffled_station_blocks():
    x, y = R.random((8, 40)), R.random((8, 40))
    moments = np.array([[[40, (y[i] * x[j]).sum(), x[j].sum(), y[i].sum(), (x[j] ** 2).sum(), (y[i] ** 2).sum()] for j in range(8)] for i in range(8)])
    order = R.permutation(8)
    assert G.shuffled_moments(moments, order) == pytest.approx(np.corrcoef(y.ravel(), x[order].ravel())[0, 1])
    linked = np.array([[[40, (x[i] * x[j]).sum(), x[j].sum(), x[i].sum(), (x[j] ** 2).sum(), (x[i] ** 2).sum()] for j in range(8)] for i in range(8)])
    assert G.block_pvalue(linked, 199)[1] == pytest.approx(0.005) and G.block_pvalue(moments, 199)[1] > 0.01


def test_best_width_has_the_least_left_out_error():
    d = L.haversine_km(PLACE, PLACE)
    x, y = np.column_stack([np.ones(24), R.random(24)]), R.random(24)
    k, error = G.best_width(x, y, d, [6, 10, 20])
    assert error == min(np.sqrt(np.mean((y - G.smoother_hats(x, d, v) @ y) ** 2)) for v in (6, 10, 20)) and k in (6, 10, 20)
    assert np.diag(G.smoother_hats(x, d, 10)).tolist() == [0] * 24


# --- joint covariates


def rows_of(n=30, held=1):
    r = np.random.default_rng(5)
    out = pd.DataFrame({"station_id": range(n), "lon": 110 + r.random(n), "lat": 31 + r.random(n), "z_a": r.normal(size=n), "z_b": r.normal(size=n), "fold": np.arange(n) % 5 + 1, "product": r.random(n) + 1, "held": held, "t": 0})
    out["train"] = out["fold"] != out["held"]
    out["sx"], out["sy"] = (out["lon"] - 110.5) / 0.3, (out["lat"] - 31.5) / 0.3
    out["obs"] = out["product"] + 0.5 + 2 * out["z_a"] - out["z_b"]
    return out


def test_joint_designs_and_names():
    groups = J.Groups({"a": ("a",), "b": ("b",)}, {"a": "local", "b": "global"})
    rows = rows_of()
    assert groups.names("residual_gwr") == ["shared_all_local"] and groups.names("mgwr") == ["intercept", "a"] and groups.effective("residual_gwr") == {"a": "local", "b": "local"}
    local, fixed = groups.design(rows, "residual_gwr")
    assert [g.shape[1] for g in local] == [5] and fixed.shape[1] == 0
    local, fixed = groups.design(rows, "mixed_gwr")
    assert [g.shape[1] for g in local] == [4] and fixed.shape[1] == 1
    for spatial, names in (("split", 4), ("shared", 2), ("intercept_only", 2)):
        own = J.Groups(groups.columns, groups.roles, spatial)
        local, fixed = own.design(rows, "mgwr")
        assert len(local) == names == len(own.names("mgwr")) and fixed.shape[1] == 1
    assert not groups.coincide("residual_gwr", "mixed_gwr") and J.Groups(groups.columns, {"a": "local", "b": "local"}).coincide("residual_gwr", "mixed_gwr") and not groups.coincide("mgwr", "mixed_gwr")
    with pytest.raises(ValueError):
        J.Groups({"a": ("a",)}, {"a": "none"})


def test_joint_predictions_find_the_residual():
    groups = J.Groups({"a": ("a",), "b": ("b",)}, {"a": "local", "b": "global"}, ridge=1e-8, tol=1e-9, most=5000)
    rows = rows_of()
    want = (rows["obs"] - rows["product"]).to_numpy()
    for method, widths in (("residual_gwr", (20,)), ("mixed_gwr", (20,)), ("mgwr", (22, 22))):
        for loo in (False, True):
            got = J.predict_time(rows, groups, method, J.Candidate(widths), loo)
            at = rows["train"] if loo else ~rows["train"]
            assert np.isnan(got[~at]).all() and np.isfinite(got[at]).all()
            assert np.corrcoef(got[at], want[at])[0, 1] > (0.9 if method == "mgwr" or loo else 0.999), (method, loo)
    few = rows.copy()
    few.loc[few.index[8:], "obs"] = np.nan
    assert np.isnan(J.predict_time(few, groups, "residual_gwr", J.Candidate((20,)))).all()


# --- hurdle


def test_wet_chances_fall_back():
    model = H.Hurdle(least_samples=10, least_stations=2, prior=20)
    n, wet = np.zeros((3, 12, 5)), np.zeros((3, 12, 5))
    n[:, 0, 1], wet[:, 0, 1] = [10, 20, 30], [5, 5, 5]
    w = np.array([1.0, 0.5, 0.0])
    rate = 15 / 60
    effective = 1.5**2 / 1.25
    chance, code = H.wet_chance(model, w, n, wet, 1, 1)
    assert code == (2 if effective < 2 else 0)
    w = np.array([1.0, 1.0, 0.0])
    assert H.wet_chance(model, w, n, wet, 1, 1) == (pytest.approx((10 + 20 * rate) / (30 + 20)), 0)
    assert H.wet_chance(model, w, n, wet, 2, 1) == (pytest.approx((10 + 20 * rate) / (30 + 20)), 1)
    assert H.wet_chance(model, w, n, wet, 2, 3) == (pytest.approx(rate), 2)
    with pytest.raises(ValueError):
        H.Hurdle(breaks=(2.0, 1.0))
    for bad in (lambda: H.FixedBandwidth(0), lambda: H.FixedBandwidth(float("nan")), lambda: H.AdaptiveBandwidth(0)):
        with pytest.raises(ValueError):
            bad()


def test_amounts_are_local_or_of_the_network():
    model = H.Hurdle(least_samples=5, least_stations=2, ridge=0.0)
    x = np.column_stack([np.ones(60), R.random(60)])
    y = 1 + 2 * x[:, 1]
    own = np.repeat([0, 1, 2], 20)
    gram = np.array([x[own == s].T @ x[own == s] for s in range(3)])
    rhs, yy, size = np.array([x[own == s].T @ y[own == s] for s in range(3)]), np.array([(y[own == s] ** 2).sum() for s in range(3)]), np.full(3, 20.0)
    beta, variance, stations, whole = H.amount_model(model, np.array([1.0, 1.0, 0.0]), gram, rhs, yy, size)
    assert np.allclose(beta, [1, 2]) and variance == pytest.approx(0, abs=1e-9) and stations == 2 and not whole
    assert H.amount_model(model, np.array([1.0, 0.0, 0.0]), gram, rhs, yy, size)[3]


# --- benchmark settings


def test_names_and_grids():
    c = B.Config(products=("a", "b"), fusions=("ols",), repeats=3, seed=7, blend_axes=("constant", "agreement_envelope"), stack=True, terrain=("slope",))
    assert c.all_products() == ["a", "b", "MERGED_OLS"] and c.seeds() == [7, 8, 9] and c.terrain_enabled and not c.joint_enabled
    assert c.methods()[-3:] == ["blend", "blend_ae", "stack"] and B.blend_bands("agreement_envelope") == 9 and B.stack_bands() == 30
    assert c.families()[1][-1] == float("inf") and c.usable([6, 6, 6]) == [12] and B.output_method("residual", "gwr") == "residual_gwr"
    assert B.repeat_dir("o", 2, 3) == "o/repeat=2" and B.repeat_dir("o", 1, 1) == "o"
    assert len(B.grid(c, "idw")) == 25 and len(B.grid(c, "gwr")) == 5
    with pytest.raises(ValueError):
        B.Config(scheme="none")
    assert np.allclose(B.equal_weights(4), [0, 0.25, 0.25, 0.25, 0.25])


def test_descent_asks_once_and_settles():
    asked = []

    def score(new):
        asked.extend(new)
        return {c: abs(c[0] - 20) + 2 * abs(c[1] - 10) for c in new}

    assert B.coordinate_descent(score, [10, 20, 40], 2) == ((20, 10), True)
    assert len(asked) == len(set(asked))
