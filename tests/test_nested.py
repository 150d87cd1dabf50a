"""Joint contexts, hurdle, nested benchmark, panel selection and fusion as Spark jobs, against loops over the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from pluvion.functions import linalg as L
from pluvion.functions import regression as G
from pluvion.operators import benchmark as B
from pluvion.operators import hurdle as H
from pluvion.operators import joint as J
from pluvion.operators import selection as N

R = np.random.default_rng(21)
N_STATIONS, TIMES = 25, 12
PLACE = pd.DataFrame({"station_id": range(N_STATIONS), "lon": 110 + R.random(N_STATIONS), "lat": 31 + R.random(N_STATIONS), "fold": np.arange(N_STATIONS) % 5 + 1})


@pytest.fixture(scope="module")
def panel():
    rows = PLACE.merge(pd.DataFrame({"t": range(TIMES)}), how="cross")
    rows["b"], rows["c"] = R.normal(size=len(rows)), R.normal(size=len(rows))
    rows["product"] = R.random(len(rows)) * 4
    rows["obs"] = np.maximum(rows["product"] + 0.8 * rows["b"] + 0.1 * R.normal(size=len(rows)), 0)
    rows.loc[R.random(len(rows)) < 0.1, "obs"] = np.nan
    rows["period"] = rows["t"] // 4
    return rows


@pytest.fixture(scope="module")
def cells(spark, panel):
    df = spark.createDataFrame(panel)
    from pyspark.sql import functions as F

    return df.withColumn("obs", F.when(~F.isnan("obs"), F.col("obs"))).cache()


GROUPS = J.Groups({"b": ("b",), "c": ("c",)}, {"b": "local", "c": "global"}, ridge=1e-6)


def test_context_by_loops(cells, panel):
    got = {(r.held, r.station_id, r.t): (r.z_b, r.sx) for r in J.context(cells, GROUPS, period="period").collect()}
    assert len(got) == 5 * len(panel)
    for held in (1, 4):
        train = panel[panel["fold"] != held]
        d = panel.assign(d=panel["b"] - panel["t"].map(train.groupby("t")["b"].mean()))
        wet = d[(d["fold"] != held) & (d["obs"] >= 0.1)].copy()
        periods = wet.groupby("station_id")["period"].nunique()
        wet["w"] = 1 / (wet["station_id"].map(periods) * wet.groupby(["station_id", "period"])["b"].transform("size"))
        m = np.average(wet["d"], weights=wet["w"])
        s = np.sqrt(np.average((wet["d"] - m) ** 2, weights=wet["w"]))
        places = PLACE[PLACE["fold"] != held]
        for r in d.sample(20, random_state=1).itertuples():
            z, sx = got[held, r.station_id, r.t]
            assert z == pytest.approx((r.d - m) / s) and sx == pytest.approx((r.lon - places["lon"].mean()) / places["lon"].std())


def test_context_without_variation_stops(cells):
    with pytest.raises(PySparkException):
        J.context(cells.withColumn("b", cells.b * 0), GROUPS).collect()


def test_joint_models_beat_the_product(cells):
    rows = J.context(cells, GROUPS).cache()
    candidates = [J.Candidate((k,)) for k in (12, 18)]
    scanned = J.scan(J.predict(rows, GROUPS, "mixed_gwr", candidates, loo=True))
    assert scanned.count() == 5 * 2 * len(J.SHRINKS)
    picked = J.best(scanned, 0.5)
    assert picked.count() == 5
    out = J.corrected(rows, GROUPS, "mixed_gwr", picked, candidates).filter("pred IS NOT NULL AND y IS NOT NULL").toPandas()
    raw = cells.filter("obs IS NOT NULL").toPandas()
    assert np.sqrt(((out["pred"] - out["y"]) ** 2).mean()) < 0.6 * np.sqrt(((raw["product"] - raw["obs"]) ** 2).mean()) and (out["pred"] >= 0).all()
    widths, settled = J.Descent(rows, GROUPS, [12, 18], least_coverage=0.0, sweeps=2).run()
    assert len(widths) == 2 and set(widths) <= {12, 18}


def test_hurdle_fit_by_loops(spark, panel):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(panel[["station_id", "lon", "lat", "t", "obs", "product"]]).withColumn("obs", F.when(~F.isnan("obs"), F.col("obs"))).withColumn("ts", F.timestamp_seconds(F.lit(1_654_041_600) + F.col("t") * 3600))
    model = H.Hurdle(bandwidth=H.AdaptiveBandwidth(12), annual=False, diurnal=False, by_month=True, least_samples=20, least_stations=3, breaks=(0.1, 2.0))
    fitted = H.fit(rows, model)
    good = panel.dropna(subset=["obs"])
    wet = good[good["obs"] >= 0.1]
    x = np.log1p(wet["product"])
    assert fitted.centre[1] == pytest.approx(x.mean()) and fitted.scale[1] == pytest.approx(x.std(ddof=0))
    got = H.predict(fitted, rows).toPandas().set_index(["target", "ts"])
    station = 3
    d = L.haversine_km(PLACE.loc[[station], ["lon", "lat"]].to_numpy(), PLACE[["lon", "lat"]].to_numpy())[0]
    w = G.weights_hurdle(d, 12)
    z = np.column_stack([np.ones(len(wet)), (x - x.mean()) / x.std(ddof=0)])
    sw, y = w[wet["station_id"]], np.log1p(wet["obs"]).to_numpy()
    n = sw.sum()
    a = (z * sw[:, None]).T @ z + 1e-4 * n * np.diag([0, 1])
    beta = np.linalg.solve(a, (z * sw[:, None]).T @ y)
    variance = max((sw * (y - z @ beta) ** 2).sum() / (n - 2), 0)
    for r in panel[panel["station_id"] == station].head(4).itertuples():
        category = sum(r.product >= e for e in (0.1, 2.0))
        own = good.assign(k=sum((good["product"] >= e).astype(int) for e in (0.1, 2.0)))
        own = own[own["k"] == category]
        rate = (own["obs"] >= 0.1).mean()
        wn, ww = w[own["station_id"]].sum(), (w[own["station_id"]] * (own["obs"] >= 0.1)).sum()
        want = (ww + 20 * rate) / (wn + 20) if wn >= 20 else ((own["obs"] >= 0.1).sum() + 20 * rate) / (len(own) + 20)
        row = got.loc[(station, pd.Timestamp(1_654_041_600 + r.t * 3600, unit="s"))]
        mean = beta @ [1, (np.log1p(r.product) - x.mean()) / x.std(ddof=0)]
        amount = max(np.exp(mean + variance / 2) - 1, 0.1)
        assert row["wet_chance"] == pytest.approx(want, rel=1e-6) and row["amount"] == pytest.approx(amount, rel=1e-6) and row["corrected"] == pytest.approx(want * amount, rel=1e-6)
    with pytest.raises(PySparkException):
        H.fit(rows.withColumn("lon", F.lit(200.0)), model).stations.collect()


def test_nested_run(spark, cells, panel):
    config = B.Config(powers=(1.0, 2.0), neighbours=(8,), adaptive=(12,), fixed=(80.0,), least_coverage=0.3)
    run = B.run(cells.select("station_id", "t", "obs", "product"), spark.createDataFrame(PLACE), config, ("idw", "residual_gwr"))
    split = run.split.toPandas()
    assert len(split) == 5 * N_STATIONS and split.groupby("held")["inner"].apply(lambda v: v.isna().sum()).eq(5).all()
    assert (split.groupby("station_id")["fold"].nunique() == 1).all()
    picked = {(r.method, r.held): r.candidate for r in run.selected.collect()}
    predictions = run.predictions.toPandas()
    fold = split.drop_duplicates("station_id").set_index("station_id")["fold"]
    # a held station's value is what the training stations of that time give with the chosen options
    for r in predictions[(predictions["method"] == "idw") & predictions["pred"].notna()].sample(15, random_state=2).itertuples():
        rows = panel[(panel["t"] == r.t) & panel["obs"].notna() & (panel["station_id"].map(fold) != r.held)]
        o = B.grid(config, "idw")[picked["idw", r.held]]
        at = PLACE.loc[[r.station_id], ["lon", "lat"]].to_numpy()
        assert r.pred == pytest.approx(G.idw(rows[["lon", "lat"]].to_numpy(), rows["obs"].to_numpy(), at, o["power"], o["k"])[0])
    methods = set(predictions["method"])
    assert {"raw", "zero", "train_clim", "hour_field_mean", "idw", "residual_gwr", "auto"} <= methods
    status = run.status.toPandas()
    assert set(status["status"]) <= {"ok", "low_coverage", "unavailable"} and len(status) == 10
    table = {r.method: r for r in B.method_scores(run, ("raw", "idw", "residual_gwr")).collect()}
    assert len({r.n for m, r in table.items() if m != "auto"}) == 1


def test_blend_and_stack(spark):
    rows = pd.DataFrame({"held": 1, "band": np.repeat([0, 1], 300), "fold": np.tile([1, 2, 3], 200), "product": 1.0, "s": R.random(600), "f": R.random(600)})
    rows["obs"] = np.where(rows["band"] == 0, 0.7 * rows["s"] + 0.3 * rows["f"], rows["f"])
    df = spark.createDataFrame(rows)
    assert {r.band: r.lam for r in B.blend_weight(df, "s", "f", band="band").collect()} == {0: 0.3, 1: 1.0}
    w = B.stack_weights(df, ["s", "f"], 100)
    assert np.allclose(w[1, 0], [0.7, 0.3], atol=1e-6) and np.allclose(w[1, 1], [0, 1], atol=1e-6)
    assert np.allclose(B.stack_weights(df, ["s", "f"], 1000)[1, 0], w[1, None])
    out = B.stacked(df, ["s", "f"], w, "s").toPandas()
    assert np.allclose(out["pred"], out["obs"], atol=1e-6)
    coefs = B.banded_coefficients(df, ["s", "f"], 50)
    assert np.allclose(coefs[2, 0], [0, 0.7, 0.3], atol=1e-5) and np.allclose(B.banded_coefficients(df, ["s", "f"], 5000)[2, 0], coefs[2, None])
    with pytest.raises(ValueError):
        B.banded_coefficients(df.withColumn("s", df.f), ["s", "f"])


def test_quantiles_of_the_other_folds(spark):
    rows = pd.DataFrame({"fold": np.arange(900) % 3 + 1, "a": R.random(900)})
    rows["obs"] = 10 * rows["a"] ** 2
    out = B.quantile_mapped(spark.createDataFrame(rows), "a").toPandas()
    assert np.abs(out["mapped"] - out["obs"]).max() < 0.6 and len(out) == 900
    grown = rows.assign(obs=np.where(rows["fold"] == 1, 1000.0, rows["obs"]))
    held = B.quantile_mapped(spark.createDataFrame(grown), "a").toPandas()
    assert held.loc[held["fold"] == 1, "mapped"].max() < 20  # its own observations take no part


def test_settled_panels_and_selection(spark):
    n, times = 14, 40
    rows = pd.DataFrame({"station_id": range(n), "lon": 110 + R.random(n), "lat": 31 + R.random(n)}).merge(pd.DataFrame({"t": range(times)}), how="cross")
    rows["period"], rows["fold"], rows["product_name"] = rows["t"] // 10, rows["station_id"] % 2 + 1, "p"
    rows["u"], rows["v"] = R.normal(size=len(rows)), R.normal(size=len(rows))
    rows["w2"] = rows["u"] + 0.01 * R.normal(size=len(rows))
    rows["y"] = 2 * rows["u"] + 0.3 * R.normal(size=len(rows))
    chain = pd.DataFrame({"station_id": np.repeat(range(100, 108), 5), "lon": 110.0, "lat": 31.0, "t": [1000 + s + k for s in range(8) for k in range(5)], "period": 9, "fold": 1, "product_name": "p", "u": 0.0, "v": 0.0, "w2": 0.0, "y": 0.0})
    df = spark.createDataFrame(pd.concat([rows, chain], ignore_index=True))
    rules = N.Rules(least_hours=5, least_stations=4, shuffles=99)
    x = N.settled(df, rules)
    assert x.filter("station_id >= 100").count() == 0 and x.count() == len(rows)
    p = N.panel(df, ["u", "v", "w2"], rules).toPandas()
    assert p.groupby("station_id")["w"].sum().round(9).eq(1).all() and abs(np.average(p["u"], weights=p["w"])) < 1e-9 and np.average(p["u"] ** 2, weights=p["w"]) == pytest.approx(1)
    moments = N.pair_moments(N.panel(df, ["u"], rules), "u")
    q = N.panel(df, ["u"], rules).toPandas().sort_values(["station_id", "t"])
    assert G.shuffled_moments(moments, np.arange(n)) == pytest.approx(np.corrcoef(q["u"], q["y"])[0, 1])
    found = N.select(df, {"u": ["u"], "v": ["v"], "w2": ["w2"]}, rules).set_index("group")
    assert found["selected"].tolist() == [True, False, True] and found["included"].sum() == 1 and set(found["role"].dropna()) <= {"local", "global"}
    vifs = N.weighted_vifs(N.panel(df, ["u", "v", "w2"], rules), ["u", "v", "w2"])
    assert vifs[0] > 100 and vifs[1] == pytest.approx(1, abs=0.2)
    few = N.run(df.filter("t < 8"), {"u": ["u"]}, ["p"], 2, N.Rules(least_hours=50))
    assert few["status"].eq("insufficient_stations_or_variation").all() and few["scheme"].tolist() == ["full", "fold_out", "fold_out"]


def test_terrain_screen():
    n = 60
    s = pd.DataFrame({"elevation": R.random(n), "slope": R.random(n), "aspect_sin": R.normal(size=n), "aspect_cos": R.normal(size=n), "flat": 1.0})
    s["r"] = 3 * s["elevation"] + s["aspect_sin"] + 0.1 * R.normal(size=n)
    out = N.terrain_screen(s, "r", {"elevation": ["elevation"], "slope": ["slope"], "aspect": ["aspect_sin", "aspect_cos"], "flat": ["flat"]}, N.Rules(shuffles=199)).set_index("group")
    assert out["kept"].to_dict() == {"elevation": True, "slope": False, "aspect": True, "flat": False} and out.loc["flat", "failed"]


def test_paired_rows_and_event_skill(spark):
    from pluvion.operators import models as M

    n = 400
    rows = pd.DataFrame({"stratum": np.where(np.arange(n) % 2, "x", "y"), "day": np.arange(n) // 10, "obs": R.random(n)})
    rows["good"], rows["bad"], rows["worse"] = rows["obs"] + 0.05 * R.normal(size=n), rows["obs"] + 0.5 * R.normal(size=n), rows["obs"] + R.normal(size=n)
    out = M.paired_rows(spark.createDataFrame(rows), ["good"], ["bad", "worse"], reps=300).toPandas()
    assert len(out) == 4 and (out["low"] > 0).all() and (out["holm"] >= out["p"]).all()
    r = rows[rows["stratum"] == "x"]
    rmse = lambda c: np.sqrt(((r[c] - r["obs"]) ** 2).mean())
    got = out[(out["stratum"] == "x") & (out["baseline"] == "bad")]["delta"].iloc[0]
    assert got == pytest.approx(rmse("bad") - rmse("good"), abs=1e-5)
    assert M.holm(np.array([0.01, 0.04, 0.03])).tolist() == pytest.approx([0.03, 0.06, 0.06])
    daily = spark.createDataFrame([("k", d, 1, 3, 2, 3, 1, 1) for d in range(20)], "k string, day int, hits_a int, misses_a int, false_a int, hits_b int, misses_b int, false_b int")
    row = M.bootstrap_events(daily, "k", "csi", 200).first()
    assert row.delta == pytest.approx(3 / 5 - 1 / 6, abs=1e-6) and row.low == pytest.approx(row.high) and row.p == 0.0


def test_kernels_terrain_and_provenance(spark, cells, tmp_path):
    from pluvion.sources import sinks

    config = B.Config(adaptive=(12, 16), fixed=(), least_coverage=0.2)
    out = B.kernel_runs(cells.select("station_id", "t", "obs", "product"), spark.createDataFrame(PLACE), config, ("bisquare", "gaussian")).toPandas()
    assert set(out["kernel"]) == {"bisquare", "gaussian", "nested"} and len(out) == 15
    place = PLACE[["lon", "lat"]].to_numpy()
    x = R.random(N_STATIONS)
    widths, settled = B.terrain_widths(place, 1 + 2 * x, [np.ones((N_STATIONS, 1)), x[:, None]], np.zeros((N_STATIONS, 0)), [10, 20], 2)
    assert len(widths) == 2
    s = PLACE.assign(e=x, r=3 * x + 0.01 * R.normal(size=N_STATIONS))
    by = B.terrain_by_fold(s, "r", {"e": ["e"]}, N.Rules(shuffles=99))
    assert by["fold"].tolist() == [0, 1, 2, 3, 4, 5] and by["kept"].all()
    (tmp_path / "a.csv").write_text("x")
    rows = {r.item: r.value for r in sinks.provenance(spark, {"k": 1}, {"a": str(tmp_path / "a.csv")}, None).collect()}
    assert rows["setting:k"] == "1" and len(rows["sha256:a"]) == 64 and rows["commit"] == "unknown"
    assert sinks.write_tables({"t": spark.createDataFrame(s.head(2))}, str(tmp_path / "o")) == [f"{tmp_path}/o/t"] and spark.read.csv(str(tmp_path / "o" / "t"), header=True).count() == 2


def test_hurdle_scan(spark, panel):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(panel[["station_id", "lon", "lat", "t", "obs", "product"]]).withColumn("obs", F.when(~F.isnan("obs"), F.col("obs"))).withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    models = [H.Hurdle(bandwidth=H.AdaptiveBandwidth(k), annual=False, diurnal=False, least_samples=20, least_stations=3) for k in (8, 20)]
    out = H.scan(rows, models).toPandas()
    assert sorted(out["candidate"]) == [0, 1] and (out["coverage"] > 0.9).all()
