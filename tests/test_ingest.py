"""Archives, specifications, disk images, remote clients and terrain on small files and stand-in services."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pluvion.sources import reanalysis as A
from pluvion.sources import remote as M
from pluvion.sources import terrain as E
from pluvion.streaming import windows as W


def archive(hours=48, lon=110.0, drop=None, repeat=False):
    time = pd.date_range("2022-01-01", periods=hours, freq="h").strftime("%Y-%m-%d %H:%M:%S")
    base = {"valid_time": time, "latitude": 31.0, "longitude": lon}
    tables = [pd.DataFrame({**base, "t2m": 290.0, "d2m": 285.0}), pd.DataFrame({**base, "sp": np.linspace(9e4, 1e5, hours)}), pd.DataFrame({**base, "u10": 1.0, "v10": -1.0})]
    if drop is not None:
        tables[1] = tables[1].drop(columns=drop)
    if repeat:
        tables[2] = pd.concat([tables[2], tables[2].iloc[:1]])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, t in enumerate(tables):
            z.writestr(f"group{i}.csv", t.to_csv(index=False))
    return out.getvalue()


def test_archives(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / "raw" / s).mkdir(parents=True)
        (tmp_path / "raw" / s / "x.zip").write_bytes(archive())
    stations = spark.createDataFrame([("s1", 110.0, 31.0), ("s2", 110.1, 31.1)], "station_id string, lon double, lat double")
    hours = A.archive_hours(spark, str(tmp_path / "raw"), stations, "2022-01-01 00:00:00", "2022-01-02 23:00:00")
    ready = A.model_ready(hours).orderBy("station_id", "time_utc").collect()
    assert len(ready) == 96 and ready[0].t2m_c == pytest.approx(16.85) and ready[0].time_bjt.hour == 8 and ready[0].wind_direction == pytest.approx(315)
    by = {}
    for r in ready:
        by.setdefault((r.station_id, r.time_bjt.month), []).append(r.sp_anomaly_hpa)
    assert all(abs(sum(v)) < 1e-6 for v in by.values())
    (tmp_path / "raw" / "s2" / "y.zip").write_bytes(archive())
    with pytest.raises(PySparkException):
        A.archive_hours(spark, str(tmp_path / "raw"), stations, "2022-01-01 00:00:00", "2022-01-02 23:00:00").count()
    with pytest.raises(PySparkException):
        A.archive_hours(spark, str(tmp_path / "raw"), stations.filter("station_id = 's1'"), "2022-01-01 00:00:00", "2022-01-03 23:00:00").count()
    for bad in (archive(drop=["sp"]), archive(repeat=True)):
        with pytest.raises(ValueError):
            A.merged(bad)
    assert A.completed({".complete": 1, "x.zip": 3}) and not A.completed({"x.zip": 3}) and not A.completed({".complete": 1, "a.zip": 1, "b.zip": 1}) and not A.completed({".complete": 1, "a.zip": 0})


def test_scalar_checks(spark):
    df = spark.createDataFrame([("3", "a_1"), ("3.0", "b-2"), ("x", "c"), ("nan", "d"), ("inf", "e"), (None, "f")], "v string, id string")
    assert [r[0] for r in df.select(A.integer_code(df.v)).collect()] == [3, 3, None, None, None, None]
    assert [r[0] for r in df.select(A.finite(df.v)).collect()] == [3.0, 3.0, None, None, None, None]
    assert df.select(A.safe_id(df.id)).count() == 6 and A.unquoted(' "a ""b"", c" ') == 'a "b", c' and A.month_selection([5, 3, 5]) == [3, 5] and A.month_selection(None, 6, 9) == [6, 7, 8, 9]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("../x",)], "id string").select(A.safe_id(F.col("id"))).collect()


def test_specification(spark, tmp_path):
    head = ",".join(A.SPEC)
    good = f"{head}\na,terrain,slope,slope,true,true,local,true\na,era5,wind,ws,true,false,,false\nb,ndvi,ndvi,ndvi_qc,true,true,global,true\n"
    (tmp_path / "s.csv").write_text(good)
    _, roles = A.covariate_spec(spark, str(tmp_path / "s.csv"), ["a", "b"])
    assert roles == {"a": {"slope": "local"}, "b": {"ndvi": "global"}}
    import hashlib

    assert A.spec_sha256(spark, str(tmp_path / "s.csv")) == hashlib.sha256(good.encode()).hexdigest()
    for bad in (good.replace("local", "none"), good.replace("a,era5,wind", "a,era5,slope"), good.replace("slope,slope,true,true", "slope,slope,true,false"), good.replace("b,ndvi,ndvi", "b,ndvi,rivers"), good.replace("a,terrain,slope", "a,era5,slope"), "product\na\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            A.covariate_spec(spark, str(tmp_path / "bad.csv"), ["a", "b"])
    with pytest.raises(ValueError):
        A.covariate_spec(spark, str(tmp_path / "s.csv"), ["a"])


def test_image_values():
    image = np.array([[1.0, 2.0], [3.0, A.FILL]])
    near, mean = A.image_values(image, None, np.array([0.2, 0.5, 1.4, -3.0, np.nan]), np.array([0.1, 0.5, 1.0, 0.0, 0.0]))
    assert near[:2].tolist() == [1.0, 1.0] and np.isnan(near[2:]).all()
    assert mean[0] == pytest.approx((0.72 * 1 + 0.08 * 2 + 0.18 * 3) / 0.98) and mean[1] == pytest.approx(2.0) and np.isnan(mean[3:]).all()
    quality = np.array([[2, 0], [0, 0]])
    assert np.isnan(A.image_values(image, quality, np.array([0.0]), np.array([0.0]))[0][0])
    assert A.accepted(1.0, 0) and not any(A.accepted(*x) for x in ((None, 0), (float("nan"), 0), (A.FILL, 0), (-1.0, 0), (31.0, 0), (1.0, 2), (1.0, None)))


def test_disk_images(spark, monkeypatch):
    side = A.S.GRID_SIDE
    x, y = A.grid_places(np.array([133.0, 110.0]), np.array([0.0, 31.0]), 133.0)
    assert x[0] == y[0] == (side - 1) / 2 and x[1] < x[0] and y[1] < y[0]
    image = np.zeros((side, side), np.float32)
    image[int(np.rint(x[1])), int(np.rint(y[1]))] = 8.0
    data = io.BytesIO()
    np.savez_compressed(data, image=image)
    start = pd.date_range("2022-06-01 05:00", periods=4, freq="15min")
    files = spark.createDataFrame([(f"f{i}", data.getvalue() if i < 4 else b"junk", 133.0, start[min(i, 3)].to_pydatetime()) for i in range(5)], "path string, content binary, sat_lon double, start timestamp")
    stations = spark.createDataFrame([("a", 110.0, 31.0), ("b", 133.0, 0.0)], "station_id string, lon double, lat double")
    points = A.image_points(files, stations)
    got = {(r.path, r.station_id, r["mode"]): r.value for r in points.collect()}
    assert got["f0", "a", "nearest"] == 8.0 and 0 < got["f0", "a", "bilinear"] <= 8 and got["f0", "b", "nearest"] == 0.0 and got["f4", "a", "unreadable"] is None
    hours = {(r.station_id, r["mode"]): (r.hour.hour, r.value) for r in A.hourly_images(points, files.select("path", "start").filter("path <> 'f4'")).collect()}
    assert hours["a", "nearest"] == (6, 8.0)
    three = {r.value for r in A.hourly_images(points.filter("path <> 'f1'"), files.select("path", "start").filter("path <> 'f4'")).collect()}
    assert three == {None}


# --- remote


class Fake:
    def __init__(self, answers):
        self.answers, self.asked, self.slept = list(answers), [], []

    def __call__(self, method, url, headers, body):
        self.asked.append((method, url, headers, body))
        status, data = self.answers.pop(0)
        return status, data if isinstance(data, bytes) else json.dumps(data).encode()

    def service(self, tries=6):
        return M.Service("https://service.example", self, tries, 1.0, self.slept.append)


def test_requests_are_tried_again():
    fake = Fake([(503, b""), (0, b""), (429, b""), (200, {"token": "t"})])
    assert fake.service().token("u", "p") == "t" and len(fake.slept) == 3 and fake.asked[0][2]["Authorization"].startswith("Basic ")
    for answers, tries in (([(401, b"no")], 6), ([(500, b"")] * 2, 2), ([(200, {})], 6)):
        with pytest.raises(M.RemoteError):
            Fake(answers).service(tries).token("u", "p")


def test_tasks_and_bundles(tmp_path):
    fake = Fake([(200, {"x": {"Available": True}, "y": {"Available": False}}), (200, {"task_id": "7"}), (200, {"status": "pending"}), (200, {"status": "done"})])
    s = fake.service()
    with pytest.raises(M.RemoteError):
        s.check_layers("P", ["x", "y", "z"])
    assert s.submit("t", {"a": 1}) == "7" and s.wait("t", "7", 2.0)["status"] == "done" and fake.slept == [2.0]
    with pytest.raises(M.RemoteError):
        Fake([(200, {"status": "error", "error": "bad"})]).service().wait("t", "7")
    good, folder = A.sha256_of(b"data"), M.Folder(str(tmp_path / "b"))
    files = {"files": [{"file_name": "a.csv", "file_id": "1", "sha256": good}]}
    assert Fake([(200, files), (200, b"data")]).service().bundle("t", "7", folder) == ["a.csv"] and folder.read("a.csv") == b"data"
    assert Fake([(200, files)]).service().bundle("t", "7", folder) == ["a.csv"]  # there already
    for answers in ([(200, files), (200, b"else")], [(200, {"files": [{"file_name": "../a", "file_id": "1"}]})], [(200, {"files": []})]):
        with pytest.raises(M.RemoteError):
            Fake(answers).service().bundle("t", "7", M.Folder(str(tmp_path / "c")), True)


def test_station_downloads_go_on(tmp_path):
    asked = []

    def fetch(request):
        asked.append(request)
        if len(asked) == 1:
            return {}
        return {"x.zip": b"z"}

    requests = {"s1": M.station_request(110, 31, list(A.VARIABLES), "2022-01-01", "2024-12-31"), "s2": {}}
    d = M.StationDownload(fetch, M.Folder(str(tmp_path)), sleep=lambda _: None)
    assert {r["status"] for r in d.run(requests)} == {"complete"} and len(asked) == 3 and d.done("s1")
    assert M.StationDownload(lambda r: pytest.fail("asked again"), M.Folder(str(tmp_path))).run(requests)[0]["status"] == "complete"
    assert json.loads(M.Folder(str(tmp_path)).read("manifest.json"))[1]["station_id"] == "s2"
    with pytest.raises(ValueError):
        M.Folder(str(tmp_path)).inside("../x")


def test_request_bodies():
    task = M.point_task("n", "P", ["x"], [("a", 110.0, 31.0)], "01-01-2022", "12-31-2024")
    assert task["params"]["coordinates"][0]["longitude"] == 110.0
    M.check_bounds([("a", 109.4, 31.2)], 109.4, 111.6, 31.2, 33.4)
    for bad in ([("a", 109.3, 31.2)], [("a", 110, 32), ("a", 110, 32)]):
        with pytest.raises(ValueError):
            M.check_bounds(bad, 109.4, 111.6, 31.2, 33.4)
    assert M.tile_names(109, 111, 31, 32) == ["Copernicus_DSM_COG_10_N31_00_E109_00_DEM", "Copernicus_DSM_COG_10_N31_00_E110_00_DEM"]
    text = M.hourly_mean_script("C", "b", "2022-01-01", "2022-02-01", "users/x")
    assert "reduceRegions" in text and "scale: 11132" in text and text.count("(") == text.count(")")


# --- terrain


def test_projection():
    e, n = E.transverse_mercator(np.array([111.0, 112.0, 111.0]), np.array([0.0, 31.0, 45.0]))
    assert e[0] == pytest.approx(500_000) and n[0] == pytest.approx(0, abs=1e-6)
    assert n[2] == pytest.approx(4_982_950.4, abs=0.1)  # 0.9996 times the meridian's arc to 45 degrees
    back = np.hypot(*(np.diff(v) for v in E.transverse_mercator(np.array([111.0, 111.01]), np.array([31.0, 31.0]))))
    assert back[0] == pytest.approx(955.1 * 0.9996, rel=2e-3)


def test_slope_of_planes(spark):
    i, j = np.meshgrid(np.arange(7), np.arange(9), indexing="ij")
    for a, b, aspect in ((2.0, 0.0, 270.0), (0.0, 3.0, 180.0), (1.0, -1.0, 315.0)):
        z = a * j - b * i  # rises to the east by a, to the north by b
        slope, angle = E.slope_aspect(z, 1.0, 1.0)
        assert np.allclose(slope[1:-1, 1:-1], np.degrees(np.arctan(np.hypot(a, b)))) and np.allclose(angle[1:-1, 1:-1], aspect) and np.isnan(slope[0]).all()
    z = 2.0 * j
    grid = spark.createDataFrame([(int(r), int(c), float(c), float(-r), float(z[r, c])) for r in range(7) for c in range(9)], "row int, col int, x double, y double, z double")
    own = E.TILE
    E.TILE = 3
    try:
        found = {(r.row, r.col): r.slope for r in E.derivatives(grid, 1.0, 1.0).collect()}
    finally:
        E.TILE = own
    want, _ = E.slope_aspect(z, 1.0, 1.0)
    assert len(found) == 63 and all((found[r, c] is None) == np.isnan(want[r, c]) and (found[r, c] is None or found[r, c] == pytest.approx(want[r, c])) for r in range(7) for c in range(9))


def test_samples_mosaics_and_relief(spark):
    grid = spark.createDataFrame([(r, c, float(c), float(-r), float(10 * r + c) if (r, c) != (2, 2) else None, 1.0) for r in range(6) for c in range(6)], "row int, col int, x double, y double, z double, slope double")
    points = spark.createDataFrame([("a", 0.5, -0.25), ("b", 1.75, -2.0), ("c", 4.0, -4.0)], "station_id string, x double, y double")
    got = {r.station_id: r.z for r in E.sample(grid, points, 1.0, ["z"]).collect()}
    assert got == {"a": pytest.approx(3.0), "b": pytest.approx(21.0), "c": pytest.approx(44.0)}  # b: its void neighbour takes no part
    near = {r.station_id: r.z for r in E.sample(grid, points, 1.0, ["z"], False).collect()}
    assert near["c"] == 44.0 and near["b"] is None
    relief = {(r.station_id, r.side): r.relief for r in E.window_relief(grid, points, [2, 4], 1.0).collect()}
    assert relief["c", 2] == 22.0 and relief["b", 2] is None
    one, two = grid.filter("col < 4").select("x", "y", "z"), grid.filter("col > 2").select("x", "y", "z")
    assert E.mosaic([one, two]).count() == 36 and E.mosaic([one, two]).filter("z IS NULL").count() == 1
    sides, relief_by = [3.0, 5.0, 7.0, 9.0, 11.0, 13.0], [40.0, 90.0, 160.0, 170.0, 175.0, 180.0]
    assert E.best_side(sides, relief_by) in sides and E.change_point(np.array([1.0, 1, 1, 9, 9])) == 3 and E.change_point(np.array([1.0, 1.0])) == 1
    assert E.columns_of(["slope", "aspect"]) == ["slope", "aspect_sin", "aspect_cos"]


def test_blocks_and_first_rows(spark):
    rows = spark.sql("SELECT 's' AS station_id, timestamp_seconds(h * 3600) AS time, IF(h = 4, NULL, CAST(h AS DOUBLE)) AS value FROM (SELECT explode(sequence(0, 8)) AS h)")
    assert [(r.total, r.known) for r in W.whole_blocks(rows, 3).orderBy("start").collect()] == [(3.0, 3), (None, 2), (21.0, 3)]
    twice = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "z")], "k int, time int, path string")
    assert [tuple(r) for r in W.first_of_each(twice, ["k"]).collect()] == [(1, 4, "z")]
    assert [tuple(r) for r in W.first_of_each(twice, ["k"], order=["path"]).collect()] == [(1, 5, "a")]
