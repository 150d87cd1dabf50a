"""Reanalysis archives of single stations, covariate specifications and the inputs of joint models.

Archives are read as binary files: a worker unpacks one archive (some MB) at a time; the hours are rows from there on.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import ship
from .tables import align_stations, era5_hours, ndvi_asof, null_if_nan

#: Variables that an archive's three tables hold between them.
VARIABLES = ("d2m", "t2m", "sp", "u10", "v10")
GROUPS = {"elevation": "terrain", "slope": "terrain", "aspect": "terrain", "temperature": "era5", "dewpoint": "era5", "pressure": "era5", "wind": "era5", "humidity": "era5", "ndvi": "ndvi"}
SAFE_ID = r"^[A-Za-z0-9_-]+$"


def safe_id(c: Column) -> Column:
    """The id; one that could leave its folder stops the job."""
    return F.when(c.rlike(SAFE_ID), c).otherwise(F.raise_error(F.concat(F.lit("unsafe station id: "), c)).cast("string"))


def finite(c: Column) -> Column:
    """A finite number of a text, else NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def unquoted(text: str) -> str:
    """A CSV field without its quotes; doubled ones inside count once."""
    row = next(csv.reader([text.strip()]), [""])
    return row[0] if row else ""


def integer_code(c: Column) -> Column:
    """A whole number of a text such as 3 or 3.0, else NULL."""
    x = c.try_cast("double")
    return F.when(x == F.floor(x), x.cast("bigint"))


def unzipped(data: bytes) -> dict[str, bytes]:
    """CSV members by name; members that point outside are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
        if any(n.startswith("/") or ".." in n.split("/") for n in names):
            raise ValueError(f"unsafe member names: {names}")
        return {n: archive.read(n) for n in sorted(names)}


def merged(data: bytes) -> tuple[pd.DataFrame, float, float]:
    """(hours with all variables, grid lon, grid lat) of an archive: three tables joined on their time, none may repeat one."""
    parts = {n: pd.read_csv(io.BytesIO(x)) for n, x in unzipped(data).items()}
    if len(parts) != 3:
        raise ValueError(f"three tables are wanted, {len(parts)} are there")
    out, place = None, None
    for name, part in parts.items():
        have = [v for v in VARIABLES if v in part.columns]
        if "valid_time" not in part.columns or not have or not {"latitude", "longitude"} <= set(part.columns):
            raise ValueError(f"{name} lacks its time, its place or every variable")
        if part["valid_time"].duplicated().any():
            raise ValueError(f"{name} repeats a time")
        here = float(part["longitude"].iloc[0]), float(part["latitude"].iloc[0])
        if place is not None and not np.allclose(place, here):
            raise ValueError("the tables are of different places")
        place = here
        part = part[["valid_time", *have]]
        out = part if out is None else out.merge(part, on="valid_time", how="outer")
    missing = [v for v in VARIABLES if v not in out.columns]
    if missing:
        raise ValueError(f"no table has {missing}")
    return out.sort_values("valid_time", ignore_index=True), *place


HOURS = "station_id string, station_lon double, station_lat double, grid_lon double, grid_lat double, time_utc timestamp, d2m double, t2m double, sp double, u10 double, v10 double"

HOUR_FIELDS = pa.schema([("station_id", pa.string()), *((c, pa.float64()) for c in ("station_lon", "station_lat", "grid_lon", "grid_lat")), ("time_utc", pa.timestamp("us", "UTC")), *((v, pa.float64()) for v in VARIABLES)])


def archive_hours(spark: SparkSession, folder: str, stations: DataFrame, first: str = "2022-01-01 00:00:00", last: str = "2024-12-31 23:00:00") -> DataFrame:
    """Raw hours of ``folder/<station>/*.zip``: exactly one archive a station and every hour from first to last, else the job stops."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("station_id", F.element_at(F.split("path", "/"), -2)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("station_id")))
    known = stations.select(safe_id(F.col("station_id")).alias("station_id"), "lon", "lat")
    rows = known.join(files, "station_id", "left").withColumn("fault", F.when(F.coalesce("n", F.lit(0)) != 1, F.raise_error(F.concat(F.lit("one archive is wanted for station "), "station_id")).cast("int")))
    begin, end = (datetime.fromisoformat(x) for x in (first, last))
    wanted = int((end - begin) / timedelta(hours=1)) + 1

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                hours, lon, lat = merged(r["content"])
                time = pd.to_datetime(hours["valid_time"])
                if len(time) != wanted or time.iloc[0] != begin or time.iloc[-1] != end or time.duplicated().any():
                    raise ValueError(f"station {r['station_id']}: {len(time)} hours from {time.iloc[0]} to {time.iloc[-1]}, wanted {wanted} from {begin} to {end}")
                out = pd.DataFrame({"station_id": r["station_id"], "station_lon": r["lon"], "station_lat": r["lat"], "grid_lon": lon, "grid_lat": lat, "time_utc": time.dt.tz_localize("UTC")})
                for v in VARIABLES:
                    out[v] = hours[v].astype(float)
                yield pa.RecordBatch.from_pandas(out, HOUR_FIELDS, preserve_index=False)

    ship(spark)
    return rows.filter("fault IS NULL").select("station_id", "lon", "lat", "content").mapInArrow(run, HOURS)


def model_ready(hours: DataFrame, offset_hours: int = 8) -> DataFrame:
    """Celsius, humidity, wind and pressure with its departure from the local month's mean, at local labels."""
    expr = lambda text: F.expr(text)
    x = hours.withColumns({
        "time_bjt": F.timestamp_add("HOUR", F.lit(offset_hours), "time_utc"), "t2m_c": F.col("t2m") - 273.15, "d2m_c": F.col("d2m") - 273.15,
        "relative_humidity": expr(S.relative_humidity("t2m", "d2m")), "wind_speed": expr(S.wind_speed("u10", "v10")), "wind_direction": expr(S.wind_direction("u10", "v10")), "sp_hpa": F.col("sp") / 100,
    })
    month = Window.partitionBy("station_id", F.date_format("time_bjt", "yyyy-MM"))
    return x.withColumn("sp_anomaly_hpa", F.col("sp_hpa") - F.avg("sp_hpa").over(month)).drop("t2m", "d2m", "sp")


def completed(folder: dict[str, int]) -> bool:
    """Is a station's folder (file name -> bytes) complete: its marker and one archive that isn't empty."""
    return ".complete" in folder and [n for n in folder if n.endswith(".zip") and folder[n] > 0] == [n for n in folder if n.endswith(".zip")] and sum(n.endswith(".zip") for n in folder) == 1


# --- specification of covariates

SPEC = ("product", "family", "variable_group", "predictor_columns", "independent_selected", "joint_vif_retained", "role", "final_included")


def covariate_spec(spark: SparkSession, path: str, products: list[str]) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(table, product -> group -> role): one row a product and group; what is included was selected, was kept, and has a role and its family."""
    table = spark.read.csv(path, header=True)
    missing = [c for c in SPEC if c not in table.columns]
    if missing:
        raise ValueError(f"the specification lacks {missing}")
    flag = lambda c: F.lower(c) == "true"
    table = table.withColumns({c: flag(F.col(c)) for c in ("independent_selected", "joint_vif_retained", "final_included")})
    rows = [r.asDict() for r in table.collect()]  # a row a product and group
    keys = [(r["product"], r["variable_group"]) for r in rows]
    if len(keys) != len(set(keys)):
        raise ValueError("the specification repeats a product and group")
    if {r["product"] for r in rows} != set(products):
        raise ValueError("the specification is of other products")
    roles: dict[str, dict[str, str]] = {p: {} for p in products}
    for r in rows:
        if r["variable_group"] not in GROUPS:
            raise ValueError(f"unknown group {r['variable_group']}")
        if not r["final_included"]:
            continue
        if not (r["independent_selected"] and r["joint_vif_retained"]):
            raise ValueError(f"{r['variable_group']} is included though the screen or the inflation left it out")
        if r["role"] not in ("local", "global") or r["family"] != GROUPS[r["variable_group"]]:
            raise ValueError(f"{r['variable_group']} has no role or another family")
        roles[r["product"]][r["variable_group"]] = r["role"]
    return table, roles


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spec_sha256(spark: SparkSession, path: str) -> str:
    """Digest of the specification's bytes, for provenance."""
    (row,) = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()
    return row["d"]


def joint_inputs(panel: DataFrame, stations: DataFrame, terrain: DataFrame | None, raw: DataFrame | None, variables: list[str], ndvi: DataFrame | None, offset_hours: int = 9) -> DataFrame:
    """The panel (station_id, time, ...) with terrain columns by station, reanalysis by hour and vegetation in force."""
    out = panel
    if terrain is not None:
        out = out.join(align_stations(stations, terrain), "station_id")
    if raw is not None:
        hours, _ = era5_hours(raw, stations, variables, offset_hours)
        out = out.join(hours, ["station_id", "time"], "left")
    if ndvi is not None:
        out = out.join(ndvi_asof(ndvi, panel.select("station_id", "time").distinct()), ["station_id", "time"], "left")
    return out


# --- disk images

FILL = 65534.0
MOST_RATE, LEAST_BAD_QUALITY = 30.0, 2
IMAGES = "path string, station_id string, value double, mode string"


def accepted(value: float | None, quality: float | None) -> bool:
    """Is a pixel's value good: known, no fill, 0 to MOST_RATE, quality below LEAST_BAD_QUALITY."""
    return value is not None and quality is not None and value == value and quality == quality and value != FILL and 0 <= value <= MOST_RATE and quality < LEAST_BAD_QUALITY


def image_values(image: np.ndarray, quality: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, bilinear) values at places counted from 0; NaN outside the grid or where nothing good is there.

    Bilinear weights are shared out among the good ones of the four neighbours.
    """
    side_x, side_y = image.shape
    quality = np.zeros(image.shape) if quality is None else quality
    good = np.isfinite(image) & (image != FILL) & (image >= 0) & (image <= MOST_RATE) & (quality < LEAST_BAD_QUALITY)

    def at(i, j):
        inside = (i >= 0) & (i < side_x) & (j >= 0) & (j < side_y)
        i, j = np.clip(i, 0, side_x - 1), np.clip(j, 0, side_y - 1)
        ok = inside & good[i, j]
        return np.where(ok, image[i, j], 0.0), ok

    known = np.isfinite(x) & np.isfinite(y)
    x0, y0 = np.where(known, x, -9), np.where(known, y, -9)
    value, ok = at(np.rint(x0).astype(int), np.rint(y0).astype(int))
    nearest = np.where(ok, value, np.nan)
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    left, low = np.floor(x0).astype(int), np.floor(y0).astype(int)
    for i in (0, 1):
        for j in (0, 1):
            w = np.abs(1 - i - (x0 - left)) * np.abs(1 - j - (y0 - low))
            value, ok = at(left + i, low + j)
            total, weight = total + np.where(ok, w * value, 0), weight + np.where(ok, w, 0)
    return nearest, np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def grid_places(lon: np.ndarray, lat: np.ndarray, sat_lon: float) -> tuple[np.ndarray, np.ndarray]:
    """Places on the full disc, counted from 0, as ``functions.scalar`` gives them in SQL."""
    dl, phi = np.radians(np.asarray(lon, float) - sat_lon), np.radians(np.asarray(lat, float))
    h, r = S.SATELLITE_HEIGHT_KM, S.RADIUS_GRID
    r1, r2, r3 = h - r * np.cos(phi) * np.cos(dl), -r * np.cos(phi) * np.sin(dl), r * np.sin(phi)
    per_pixel = S.PIXEL_M / 1000.0 / (h - r)
    middle = (S.GRID_SIDE - 1) / 2
    return np.arctan2(-r2, r1) / per_pixel + middle, np.arcsin(-r3 / np.sqrt(r1**2 + r2**2 + r3**2)) / per_pixel + middle


def npz_reader(data: bytes) -> tuple[np.ndarray, np.ndarray | None, float | None]:
    """(image [x, y], quality, satellite longitude) of a numpy archive with image, and quality and sat_lon where they are known."""
    with np.load(io.BytesIO(data)) as x:
        return x["image"], x["quality"] if "quality" in x else None, float(x["sat_lon"]) if "sat_lon" in x else None


def image_points(files: DataFrame, stations: DataFrame, reader=npz_reader) -> DataFrame:
    """IMAGES: every station's value in every image by nearest pixel and bilinear. files: (path, content, sat_lon of the name).

    ``reader`` turns a file's bytes into (image, quality, satellite longitude or None); stations are a network's rows and go
    to every task, their places are worked out once for each longitude. Unreadable files give NULL values.
    """
    network = stations.select("station_id", "lon", "lat").orderBy("station_id").toPandas()  # a network

    def run(batches):
        places: dict[float, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    image, quality, own = reader(r["content"])
                    sat = own if own is not None else r["sat_lon"]
                    if sat not in places:
                        places[sat] = grid_places(network["lon"], network["lat"], sat)
                    found = dict(zip(("nearest", "bilinear"), image_values(image, quality, *places[sat]), strict=True))
                except (ValueError, KeyError, OSError, zipfile.BadZipFile):
                    found = {"unreadable": np.full(len(network), np.nan)}
                for mode, values in found.items():
                    out = pd.DataFrame({"path": r["path"], "station_id": network["station_id"].astype(str), "value": np.asarray(values, float), "mode": mode})
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    ship(files.sparkSession)
    return files.select("path", "content", "sat_lon").mapInArrow(run, IMAGES).withColumn("value", null_if_nan(F.col("value")))


def hourly_images(points: DataFrame, times: DataFrame) -> DataFrame:
    """(station_id, hour, mode, value): means of four quarter-hour images, NULL where one is missing; labels end the hour. times: (path, start)."""
    x = points.filter("mode <> 'unreadable'").join(times, "path")
    hour = F.timestamp_add("HOUR", F.lit(1), F.date_trunc("hour", "start"))
    return x.groupBy("station_id", hour.alias("hour"), "mode").agg(F.when((F.count("value") == 4) & (F.count_distinct(F.minute("start")) == 4), F.avg("value")).alias("value"))


def month_selection(months: list[int] | None, first: int = 1, last: int = 12) -> list[int]:
    """Sorted different months; none named: first to last."""
    chosen = sorted(set(months)) if months else list(range(first, last + 1))
    if not chosen or chosen[0] < 1 or chosen[-1] > 12:
        raise ValueError(f"months are 1 to 12: {chosen}")
    return chosen


def json_text(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True) + "\n"


def is_safe_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_.-]+", name)) and name not in (".", "..")
