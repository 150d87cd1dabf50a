from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException

from pluvion.sources import sinks
from pluvion.sources import tables as T
from pluvion.streaming import windows as W


def test_wide_round_trip(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Time,s1,s2\n2022-06-01 05:00:00,1.5,NaN\n2022-06-01T06:00:00Z,,2\n")
    df = T.read_wide(spark, str(tmp_path / "w.csv"))
    got = {(r.station_id, r.time.hour): r.value for r in df.collect()}
    assert got == {("s1", 5): 1.5, ("s2", 5): None, ("s1", 6): None, ("s2", 6): 2.0}
    assert sinks.wide(df).columns == ["time", "s1", "s2"]
    sinks.write_wide(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    sinks.write_years(df, str(tmp_path / "years"))
    assert spark.read.parquet(str(tmp_path / "years")).select("utc_year").distinct().count() == 1


def test_unknown_time_stops(spark):
    df = spark.createDataFrame([("June 1st",)], "t string")
    with pytest.raises(PySparkException):
        df.select(T.parse_time(df.t)).collect()


def test_stations(spark, tmp_path):
    (tmp_path / "s.csv").write_text("STATION_ID,LON,Lat\na,110,32\nb,120,32\nc,109.4,31.2\n")
    df = T.read_stations(spark, str(tmp_path / "s.csv"))
    assert [r.station_id for r in T.in_box(df).collect()] == ["a", "c"]
    (tmp_path / "d.csv").write_text("station_id,lon,lat\na,110,32\na,111,32\n")
    with pytest.raises(PySparkException):
        T.read_stations(spark, str(tmp_path / "d.csv")).collect()
    ids = spark.createDataFrame([("a",), ("z",)], "station_id string")
    with pytest.raises(PySparkException):
        T.align_stations(ids, df).collect()


def test_satellite_hours(spark):
    rows = [("2022-06-01 00:00:00", "a", 1.0), ("2022-06-01 00:00:00", "a", 1.0), ("2022-06-01 01:00:00", "a", float("nan"))]
    out = {r.time.hour: r.value for r in T.satellite_hours(spark.createDataFrame(rows, "time string, station_id string, mm double"), "mm").collect()}
    assert out == {9: 1.0, 10: None}
    with pytest.raises(PySparkException):
        T.satellite_hours(spark.createDataFrame([*rows, ("2022-06-01 00:00:00", "a", 2.0)], "time string, station_id string, mm double"), "mm").collect()


def test_alignment(spark):
    s = "station_id string, time timestamp, value double"
    t = [datetime(2022, 6, 1, h) for h in range(3)]
    obs = spark.createDataFrame([("a", t[0], 1.0), ("a", t[1], None), ("b", t[0], 3.0)], s)
    sat = spark.createDataFrame([("a", t[0], 5.0), ("a", t[2], 6.0)], s)
    assert [(r.station_id, r.obs, r.sat) for r in T.align({"sat": sat}, obs).collect()] == [("a", 1.0, 5.0)]


def test_era5_and_ndvi(spark):
    t = datetime(2022, 1, 1)
    raw = spark.createDataFrame([("a", t, 1.0), ("a", t, 2.0), ("x", t, 3.0), ("a", datetime(2022, 1, 1, 1, 30), 4.0)], "station_id string, time_utc timestamp, t2m double")
    kept, quality = T.era5_hours(raw, spark.createDataFrame([("a",)], "station_id string"), ["t2m"])
    assert [(r.time.hour, r.t2m) for r in kept.collect()] == [(9, 1.0)]
    assert quality.collect()[0].asDict() == {"rows": 4, "unknown_station": 1, "off_hour": 1, "duplicates": 1, "missing_t2m": 0}
    ndvi = spark.createDataFrame([("a", date(2022, 1, 3), 0.4, 0.4), ("a", date(2022, 1, 9), None, 0.5)], "station_id string, observation_date date, ndvi_qc double, ndvi_land_qc double")
    hours = spark.createDataFrame([("a", datetime(2022, 1, 3, 23)), ("a", datetime(2022, 1, 4)), ("a", datetime(2022, 2, 4, 23)), ("a", datetime(2022, 2, 5))], "station_id string, time timestamp")
    assert [r.ndvi for r in T.ndvi_asof(ndvi, hours).orderBy("time").collect()] == [None, 0.4, 0.4, None]


def test_modis_files_and_raster(spark, tmp_path):
    rows = [("2024-02-18", 60, 0, "Land (Nothing else)", 5000.0), ("2023-12-19", 3, 3, "Shallow ocean", 5000.0), ("2024-02-18", 400, 1, "Shoreline", -3000.0)]
    out = T.modis_clean(spark.createDataFrame(rows, "composite_start string, doy int, pixel_reliability int, land_water string, ndvi_raw double")).collect()
    assert [str(r.observation_date) for r in out] == ["2024-02-29", "2024-01-03", "None"]
    assert [r.quality_class for r in out] == ["good", "cloudy", "marginal"] and [r.ndvi_land_qc for r in out] == [0.5, None, None]
    names = [f"/d{k}/S_1330E_L2_{a}_{b}_4000M.NC" for k in (1, 2) for a, b in (("20220601000000", "20220601001459"), ("20220601001500", "20220601002959"), ("20220601003000", "20220601004459"), ("20220601004500", "20220601005959"))]
    files = T.geos_files(spark.createDataFrame([(n,) for n in names], "path string"))
    assert files.count() == 4 and {r.sat_lon for r in files.collect()} == {133.0}
    assert [r.complete for r in T.hourly_quality(files, "2022-06-01 00:00:00", "2022-06-01 01:00:00").orderBy("hour").collect()] == [True, False]
    (tmp_path / "g.xyz").write_text("1 20 5\n2 20 6\n1 10 -9999\n2 10 8\n")
    assert {(r.row, r.col): r.z for r in T.raster_xyz(spark, str(tmp_path / "g.xyz")).collect()} == {(1, 1): 5, (1, 2): 6, (2, 1): None, (2, 2): 8}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", datetime(2022, 6, 1, h, 15 * q), 1.0) for h in range(4) for q in range(4) if (h, q) != (1, 2)]
    spark.createDataFrame(rows, "station_id string, ts timestamp, value double").write.parquet(src)
    stream = spark.readStream.schema("station_id string, ts timestamp, value double").parquet(src)
    q = W.hourly_from_segments(stream).writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.hour.hour for r in spark.table("hourly").collect()} <= {0, 2, 3}
    batch = W.hourly_from_segments(spark.read.parquet(src))
    assert {r.hour.hour for r in batch.collect()} == {0, 2, 3}
    hours = spark.createDataFrame([("a", datetime(2022, 6, 1, h), 1.0 if h in (2, 4, 9) else 0.0) for h in range(24)], "station_id string, time timestamp, value double")
    assert sorted(r.wet_hours for r in W.rain_events(hours).collect()) == [1, 2]
    assert sorted(r.known for r in W.met_days(hours).collect()) == [9, 15]
    assert W.first_of_each(hours, ["station_id"]).count() == 1
