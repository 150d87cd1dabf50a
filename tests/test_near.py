"""Large networks by lists of neighbours and blocks, against the full matrices."""

import numpy as np
import pytest

from pluvion.functions import linalg as L
from pluvion.functions import near
from pluvion.functions import regression as G

R = np.random.default_rng(11)
PLACE = R.uniform((109.4, 31.2), (111.6, 33.4), (300, 2))
PLACE[40:44] = PLACE[39]  # five in one place
AT = R.uniform((109.4, 31.2), (111.6, 33.4), (70, 2))
X = np.column_stack([np.ones(300), R.normal(size=300)])
X_AT = np.column_stack([np.ones(70), R.normal(size=70)])
Y = X[:, 1] * (PLACE[:, 0] - 110) + R.normal(size=300)
FIXED, FIXED_AT = R.normal(size=(300, 1)), R.normal(size=(70, 1))


@pytest.fixture
def by_blocks(monkeypatch):
    def small():
        for name, value in (("WHOLE", 0), ("HELD", 2000), ("BLOCK", 16)):
            monkeypatch.setattr(near, name, value)

    return small


@pytest.mark.parametrize("k", [1, 8, 21, 299, 400])
@pytest.mark.parametrize("far", [False, True])
def test_nearest_is_that_of_the_matrix(by_blocks, k, far):
    by_blocks()
    train = np.column_stack([PLACE[:, 0] * 150 % 360 - 180, PLACE[:, 1]]) if far else PLACE
    for target, same in ((AT, False), (train, True)):
        d = L.haversine_km(target, train)
        if same:
            np.fill_diagonal(d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        index, km = near.nearest(train, target, k, same)
        value = np.take_along_axis(d, order, 1)
        wide = order.shape[1]
        assert np.array_equal(km[:, :wide], value) and np.isinf(km[:, wide:]).all()
        assert np.array_equal(index[:, :wide], np.where(np.isfinite(value), order, -1)) and (index[:, wide:] == -1).all()


@pytest.mark.parametrize("bw, kernel, adaptive", [(12, "bisquare", True), (4, "bisquare", True), (12, "boxcar", True), (60.0, "bisquare", False)])
@pytest.mark.parametrize("loo", [False, True])
def test_smoothers_multiply_alike(by_blocks, bw, kernel, adaptive, loo):
    xg, target = (X, PLACE) if loo else (X_AT, AT)
    whole = near.smoother(X, xg, PLACE, target, bw, kernel, adaptive, loo=loo)
    by_blocks()
    got = near.smoother(X, xg, PLACE, target, bw, kernel, adaptive, loo=loo)
    assert isinstance(whole, np.ndarray) and not isinstance(got, np.ndarray)
    assert np.allclose(got @ Y, whole @ Y, rtol=1e-7, atol=1e-7)


def test_models_fit_alike(by_blocks):
    run = lambda: (L.mixed_gwr(PLACE, Y, X, FIXED, 12, AT, X_AT, FIXED_AT), L.multiscale_gwr(PLACE, Y, [X[:, :1], X[:, 1:]], [20, 12], AT, [X_AT[:, :1], X_AT[:, 1:]]))
    whole = run()
    by_blocks()
    assert all(np.isfinite(a).all() and np.allclose(a, b, rtol=1e-6, atol=1e-6) for a, b in zip(whole, run(), strict=True))


def test_calibration_alike(by_blocks):
    d = L.haversine_km(PLACE, PLACE)
    for k in (12, 4):
        whole = L.gwr_calibrate(X, Y, L.kernel_weights(d, L.adaptive_width(d, k)[:, None]))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near, "HELD", 2000)
            got = near.calibrate(X, Y, PLACE, k)
        assert all(np.isclose(got[c], whole[c], rtol=1e-6) for c in ("rss", "sigma", "trace", "aic"))


def test_large_networks_make_no_matrix(monkeypatch):
    def refused(*a, **b):
        raise AssertionError("a matrix of all stations")

    n = 2500
    place = R.uniform((109.4, 31.2), (111.6, 33.4), (n, 2))
    x, y = np.column_stack([np.ones(n), R.normal(size=n)]), R.normal(size=n)
    monkeypatch.setattr(L, "local_hat", refused)
    monkeypatch.setattr(L, "projection", refused)
    assert np.isfinite(L.mixed_gwr(place, y, x, R.normal(size=(n, 1)), 12, place[:2000], x[:2000], R.normal(size=(2000, 1)))).all()


@pytest.mark.parametrize("angular", [False, True])
@pytest.mark.parametrize("same", [False, True])
def test_distance_weights_alike(by_blocks, angular, same):
    target = PLACE if same else np.concatenate([AT, PLACE[:5]])
    options = [(p, k) for p in (1.0, 2.0, 1.5) for k in (8, None, 280)]
    whole = [G.idw(PLACE, Y, target, p, k, same, angular) for p, k in options]
    by_blocks()
    for a, b in zip(whole, G.idw_options(PLACE, Y, target, options, same, angular), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    assert np.allclose(G.idw(PLACE, Y, target, 2.0, 8, same, angular), whole[options.index((2.0, 8))], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kernel, adaptive, bw", [("bisquare", True, 12), ("bisquare", True, 4), ("bisquare", False, 30.0), ("gaussian", True, 12), ("gaussian", False, 30.0)])
@pytest.mark.parametrize("same", [False, True])
def test_planes_alike(by_blocks, kernel, adaptive, bw, same):
    target = PLACE if same else AT
    whole = G.gwr(PLACE, Y, target, kernel, adaptive, bw, same)
    by_blocks()
    got = G.gwr(PLACE, Y, target, kernel, adaptive, bw, same)
    assert np.array_equal(np.isnan(got), np.isnan(whole)) and np.allclose(got, whole, rtol=1e-6, atol=1e-6, equal_nan=True)


@pytest.mark.parametrize("loo", [False, True])
def test_several_groups_fit_alike(by_blocks, loo):
    run = lambda: (
        G.mixed(Y, PLACE, X, FIXED, AT, X_AT, FIXED_AT, 20, loo=loo),
        G.damped(Y, PLACE, [X[:, :1], X[:, 1:]], FIXED, AT, [X_AT[:, :1], X_AT[:, 1:]], FIXED_AT, [20, 30], loo=loo, ridge=1e-2),
        G.global_ridge(np.column_stack([X, FIXED]), Y, X, 1e-6, True),
    )
    whole = run()
    by_blocks()
    for a, b in zip(whole, run(), strict=True):
        assert np.array_equal(np.isnan(a), np.isnan(b)) and np.allclose(a, b, rtol=1e-6, atol=1e-6, equal_nan=True)
    assert np.isfinite(whole[0]).all()


def test_hurdle_of_the_near_is_that_of_all(spark, tmp_path):
    from pluvion.operators import models, nearest

    n = 60
    ids = R.permutation(n)
    rows = [(int(i), float(x), float(y), (R.uniform(0.5, 2) * np.array([30.0, 3.0, 3.0, 9.0])).tolist(), R.normal(20, 5, 2).tolist(), 60.0, float(R.integers(5, 30)), 30.0) for i, (x, y) in zip(ids, PLACE[:n])]
    own = spark.createDataFrame(rows, "station_id bigint, lon double, lat double, gram array<double>, rhs array<double>, yy double, wet double, n double")
    pairs = [(a[0], float(nearest.km(np.array([a[1:3]]), np.array([b[1:3]]))[0, 0]), *b[3:]) for a in rows for b in rows]
    stats = spark.createDataFrame(pairs, "target bigint, km double, gram array<double>, rhs array<double>, yy double, wet double, n double")
    for k in (6, 20, 70):
        whole, got = ({r[0]: tuple(r)[1:] for r in x.collect()} for x in (models.hurdle(stats, 2, k, samples=30.0), nearest.hurdle(own, 2, k, samples=30.0)))
        assert whole.keys() == got.keys() == set(ids.tolist())
        assert all(w[2] == g[2] and np.allclose(w[:2], g[:2], atol=2e-6) for w, g in ((whole[i], got[i]) for i in whole))


@pytest.mark.parametrize("name", ["residual_scan_best", "spatial_holdout", "nested_bandwidth_cv", "fusion_lag_neighbour_features", "hurdle_gwr"])
def test_no_join_of_all_stations(spark, name, monkeypatch):
    from pluvion.operators import spatial
    from pluvion.plans import catalogue

    texts = []
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **b: texts.append(text) or sql(self, text, *a, **b))
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert texts and not any(spatial.pairs() in x or "JOIN reports" in x for x in texts)


def test_dense_hours(spark, monkeypatch):
    from pluvion.operators import nearest

    monkeypatch.setattr(nearest, "DENSE", 4)
    stations = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 0.0, 0.3), (None, None, None)], "station_id bigint, lon double, lat double")
    seen = spark.createDataFrame([(1, 0, 2.0, 0), (1, 1, 0.0, 1), (2, 1, 4.0, 0), (2, 2, 0.0, 1), (3, 2, 6.0, 1), (3, 3, 0.0, 0), (None, 1, 9.0, 0)], "station_id bigint, h bigint, a double, bad int")
    got = {(r.station_id, r.h): tuple(r)[2:] for r in nearest.hour_features(stations, seen, 2).collect()}
    assert got == {
        (1, 0): (2.0, 2.0, 2.0, 0.0), (1, 1): (None, 2.0, 0.0, 2.0), (1, 2): (0.0, 0.0, 0.0, 0.0), (1, 3): (0.0, 0.0, 0.0, 0.0),
        (2, 0): (0.0, 0.0, 4.0, 1.0), (2, 1): (4.0, 0.0, 4.0, 0.0), (2, 2): (None, 4.0, 0.0, 0.0), (2, 3): (0.0, 0.0, 0.0, 0.0),
        (3, 0): (0.0, 0.0, 0.0, 1.0), (3, 1): (0.0, 0.0, 0.0, 4.0), (3, 2): (None, 0.0, 0.0, 0.0), (3, 3): (0.0, 0.0, 0.0, 0.0),
        **{(None, h): (0.0, 0.0, 0.0, 0.0) for h in range(4)},
    }
    assert nearest.hour_features(stations, seen.limit(0)).count() == 0


def test_scans_read_known_rows_only(spark):
    from pluvion.operators import joint as J

    r = np.random.default_rng(2)
    rows = [(h, s, t, s % 2, float(PLACE[s, 0]), float(PLACE[s, 1]), None if r.random() < 0.2 else float(r.gamma(2)), None if r.random() < 0.2 else float(r.gamma(2)), *map(float, r.normal(size=4))) for t in range(2) for h in (0, 1) for s in range(60)]
    data = spark.createDataFrame(rows, "held bigint, station_id bigint, t bigint, fold bigint, lon double, lat double, obs double, product double, sx double, sy double, z_b double, z_c double")
    groups = J.Groups({"b": ("b",), "c": ("c",)}, {"b": "local", "c": "global"}, ridge=1e-2)
    assert J.known(data).count() < data.filter("fold <> held").count()
    for method in ("mixed_gwr", "mgwr"):
        candidates = [J.Candidate((12,) * len(groups.names(method)))]
        a, b = (sorted(map(tuple, J.scan(J.predict(x, groups, method, candidates, loo=True)).collect()), key=lambda x: x[:3]) for x in (data, J.known(data)))
        assert len(a) == 10 and [x[:4] for x in a] == [x[:4] for x in b] and np.allclose(np.array(a, float), np.array(b, float), equal_nan=True)


def test_widths_share_their_nearest(by_blocks, monkeypatch):
    run = lambda: L.multiscale_gwr(PLACE, Y, [X[:, :1], X[:, 1:]], [20, 12], AT, [X_AT[:, :1], X_AT[:, 1:]])
    want = run()
    by_blocks()
    calls, plain = [], near.nearest
    monkeypatch.setattr(near, "nearest", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert np.allclose(run(), want) and len(calls) == 2  # of the training places and of the targets


def test_spline_holds_few_matrices():
    import tracemalloc

    place = R.uniform((109.4, 31.2), (111.6, 33.4), (1500, 2))
    y = np.sin(3 * place[:, 0]) + place[:, 1]
    L.tps_predict(place[:50], y[:50], place[:5])
    tracemalloc.start()
    got = L.tps_predict(place[:1400], y[:1400], place[1400:])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(got - y[1400:]).max() < 0.5 and most < 4 * 8 * 1400**2


def test_squared_distances_of_near_and_far_places():
    r = np.random.default_rng(4)
    place = r.uniform((109.4, 31.2), (111.6, 33.4), (300, 2))
    place[:20] = place[20:40] + r.uniform(-1e-6, 1e-6, (20, 2))  # within 0.2 m
    place[40] = place[41]
    for train in (place, np.concatenate([place, [[-70.0, -33.0]]])):
        got = near.Squares(train).of(place)
        assert np.allclose(got, L.haversine_km(place, train) ** 2, rtol=1e-10, atol=1e-18) and got[40, 41] == 0


def test_all_stations_are_met_without_the_haversine_of_every_pair(monkeypatch):
    r = np.random.default_rng(6)
    place, y, target = r.uniform((109.4, 31.2), (111.6, 33.4), (3000, 2)), r.gamma(1, 5, 3000), r.uniform((109.4, 31.2), (111.6, 33.4), (2000, 2))
    target[7] = place[9]  # coincident: that station's value
    wanted = [G._met(L.haversine_km(target[:20], place), np.broadcast_to(y, (20, 3000)), [1.0, 2.0], None)[i] for i in (0, 1)]
    asked = []
    whole = L.haversine_km
    for module in (near.L, G):
        monkeypatch.setattr(module, "haversine_km", lambda a, b, *x: asked.append(len(a) * len(b)) or whole(a, b, *x))
    got = G.idw_options(place, y, target, [(1.0, None), (2.0, None)])
    assert np.isfinite(G.gwr(place, y, target, "bisquare", False, 50.0)).all() and np.isfinite(G.gwr(place, y, target, "bisquare", False, np.inf)).all()
    assert sum(asked) <= 10 * len(place)
    assert got[0][7] == y[9] and all(np.allclose(a[:20], b, rtol=1e-10) for a, b in zip(got, wanted, strict=True))


def test_folds_fill_as_one_point_after_the_other():
    import time

    r = np.random.default_rng(8)
    for n, k in ((1, 1), (7, 3), (200, 5), (203, 7)):
        squared, room = np.round(r.uniform(0, 3, (n, k)), 1), np.bincount(r.integers(0, k, n), minlength=k)
        two = np.partition(squared, 1, axis=1) if k > 1 else np.hstack([squared, squared])
        left, wanted = room.copy(), np.zeros(n, int)
        for i in np.argsort(-(two[:, 1] - two[:, 0]), kind="stable"):
            wanted[i] = np.argmin(np.where(left > 0, squared[i], np.inf))
            left[wanted[i]] -= 1
        assert np.array_equal(L.nearest_with_room(squared, room), wanted)
    began = time.process_time()
    L.nearest_with_room(r.uniform(size=(300_000, 5)), np.full(5, 60_000))
    assert time.process_time() - began < 0.5
