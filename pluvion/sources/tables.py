"""Readers of station, panel, satellite, reanalysis, vegetation and raster tables into long form.

A missing number is NULL from here on: NaN is turned away on reading, since it compares differently across engines.
Checks are part of the plan (``assert_true`` and ``raise_error``), so a bad row stops the job that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyyMMddHH")
UTC_SHIFT_HOURS = 9
#: Study box in degrees (west, east, south, north).
STUDY_BOX = (109.4, 111.6, 31.2, 33.4)


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def parse_time(text: Column) -> Column:
    """Timestamp of a text in one of five formats, a trailing Z allowed; anything else stops the job."""
    plain = F.regexp_replace(F.trim(text), "Z$", "")
    found = F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS))
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("no known time format: "), text)).cast("timestamp")))


def column(df: DataFrame, name: str, label: str = "table") -> str:
    """The table's own spelling of a column, whatever its case."""
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise ValueError(f"{label} has no column {name}")


def read_wide(spark: SparkSession, path: str, time_col: str = "time") -> DataFrame:
    """(station_id, time, value) of a file with a time column and one column a station."""
    df = spark.read.csv(path, header=True)
    time = column(df, time_col, path)
    ids = [c for c in df.columns if c != time]
    tall = df.unpivot([time], ids, "station_id", "raw")
    return tall.select("station_id", parse_time(F.col(f"`{time}`")).alias("time"), null_if_nan(F.expr("try_cast(raw AS DOUBLE)")).alias("value"))


def read_stations(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """(station_id, lon, lat, ...) with canonical names; ids are unique and places lie on the globe."""
    df = spark.read.csv(path, header=True)
    want = {"station_id": "station_id", "lon": "lon", "lat": "lat"} | (names or {})
    df = df.withColumnsRenamed({column(df, have, path): to for to, have in want.items()})
    number = Window.partitionBy("station_id")
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    checked = df.withColumns({"station_id": F.col("station_id").cast("string"), "lon": lon, "lat": lat, "__n": F.count("*").over(number)})
    bad = (F.col("__n") > 1) | ~F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    return checked.withColumn("lon", F.when(bad, F.raise_error(F.concat(F.lit("station repeats or lies off the globe: "), "station_id")).cast("double")).otherwise(F.col("lon"))).drop("__n")


def in_box(stations: DataFrame, box: tuple[float, float, float, float] = STUDY_BOX) -> DataFrame:
    """Stations in the closed box, by id."""
    west, east, south, north = box
    return stations.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).orderBy("station_id")


def align_stations(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The table's rows for the ids; a missing or repeated id stops the job."""
    t = table.withColumn("__n", F.count("*").over(Window.partitionBy("station_id")))
    out = ids.select("station_id").join(t, "station_id", "left")
    fault = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit("no row for station "), "station_id")).cast("bigint")).when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("station repeats: "), "station_id")).cast("bigint")).otherwise(F.col("__n"))
    return out.withColumn("__n", fault).filter("__n = 1").drop("__n")


def month_files(spark: SparkSession, folder: str, product: str, years: list[int] | None = None, months: list[int] | None = None) -> DataFrame:
    """(path, year, month) of a product's monthly files; the listing runs through Spark's file sources."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{product}_*_hourly_long_*.csv").load(folder).select("path")
    stamp = F.regexp_extract("path", r"_(\d{6})\.csv$", 1)
    out = found.select("path", stamp.substr(1, 4).cast("int").alias("year"), stamp.substr(5, 2).cast("int").alias("month")).filter("year IS NOT NULL")
    if years:
        out = out.filter(F.col("year").isin(years))
    if months:
        out = out.filter(F.col("month").isin(months))
    return out.orderBy("year", "month")


def satellite_hours(raw: DataFrame, value: str, shift_hours: int = UTC_SHIFT_HOURS) -> DataFrame:
    """(station_id, time, value) of long UTC rows at local hour-ending labels; repeats must agree."""
    time = F.timestamp_add("HOUR", F.lit(shift_hours), parse_time(F.col("time"))) if dict(raw.dtypes)["time"] == "string" else F.timestamp_add("HOUR", F.lit(shift_hours), F.col("time"))
    x = raw.select(F.col("station_id").cast("string").alias("station_id"), time.alias("time"), null_if_nan(F.col(value).cast("double")).alias("value"))
    grouped = x.groupBy("station_id", "time").agg(F.avg("value").alias("value"), F.countDistinct("value").alias("__k"))
    fault = F.raise_error(F.concat(F.lit("rows disagree at "), F.col("station_id"), F.lit(" "), F.col("time").cast("string"))).cast("double")
    return grouped.withColumn("value", F.when(F.col("__k") > 1, fault).otherwise(F.col("value"))).drop("__k")


def align(products: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """(station_id, time, obs, <product> ...) at the stations and times for which every table has a row."""
    out = reference.withColumnRenamed("value", "obs")
    for name, df in products.items():
        for key in ("station_id", "time"):
            out = out.join(df.select(key).distinct(), key, "left_semi")
        out = out.join(df.withColumnRenamed("value", name), ["station_id", "time"], "left")
    return out


def era5_hours(raw: DataFrame, ids: DataFrame, variables: list[str], offset_hours: int = UTC_SHIFT_HOURS) -> tuple[DataFrame, DataFrame]:
    """(rows at local labels, quality counts): unknown stations and part hours are left out.

    Of rows repeated at one UTC hour the first counts: by source_file and source_row where the rows say where they stood, else
    by their values, so the choice doesn't hang on how files are split.
    """
    known = ids.select("station_id").distinct().withColumn("__known", F.lit(True))
    order = [c for c in ("source_file", "source_row") if c in raw.columns] or sorted(variables)
    x = raw.join(known, "station_id", "left")
    x = x.withColumn("__rn", F.row_number().over(Window.partitionBy("station_id", "time_utc").orderBy(*order)))
    part = (F.minute("time_utc") != 0) | (F.second("time_utc") != 0)
    finite = [F.col(v).isNotNull() & ~F.isnan(v) for v in variables]
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    quality = x.agg(
        F.count("*").alias("rows"), count(F.col("__known").isNull()).alias("unknown_station"), count(part).alias("off_hour"), count(F.col("__rn") > 1).alias("duplicates"),
        *(count(~f).alias(f"missing_{v}") for f, v in zip(finite, variables, strict=True)),
    )
    kept = x.filter(F.col("__known") & ~part & (F.col("__rn") == 1)).withColumn("time", F.timestamp_add("HOUR", F.lit(offset_hours), "time_utc"))
    return kept.select("station_id", "time", *(null_if_nan(F.col(v)).alias(v) for v in variables)), quality


def ndvi_asof(ndvi: DataFrame, hours: DataFrame, max_age_days: int = 32) -> DataFrame:
    """hours with the latest vegetation value in force: from the day after it was observed, for ``max_age_days``.

    A union ordered by time and one running window a station: no range join.
    """
    seen = ndvi.filter("ndvi_qc IS NOT NULL AND ndvi_land_qc IS NOT NULL").select("station_id", F.date_add("observation_date", 1).cast("timestamp").alias("time"), F.struct(F.date_add("observation_date", 1).cast("timestamp").alias("since"), "ndvi_qc").alias("ndvi"), F.lit(0).alias("__kind"))
    asked = hours.select("station_id", "time", F.lit(None).cast(seen.schema["ndvi"].dataType).alias("ndvi"), F.lit(1).alias("__kind"))
    w = Window.partitionBy("station_id").orderBy("time", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = seen.unionByName(asked).withColumn("ndvi", F.last("ndvi", ignorenulls=True).over(w)).filter("__kind = 1")
    fresh = F.col("time") < F.timestamp_add("DAY", F.lit(max_age_days), F.col("ndvi.since"))
    return out.select("station_id", "time", F.when(fresh, F.col("ndvi.ndvi_qc")).alias("ndvi"))


def modis_clean(raw: DataFrame) -> DataFrame:
    """Vegetation rows with observation date, quality class, land class and cleaned index."""
    start, doy = F.to_date("composite_start"), F.col("doy").cast("int")
    first = F.make_date(F.year(start), F.lit(1), F.lit(1))
    length = F.dayofyear(F.make_date(F.year(start), F.lit(12), F.lit(31)))
    # a composite that starts in December may hold days of January
    after = F.when(doy < F.dayofyear(start), F.make_date(F.year(start) + 1, F.lit(1), F.lit(1))).otherwise(first)
    observed = F.when(doy.between(1, length), F.date_add(after, doy - 1))
    quality = F.element_at(F.array(*map(F.lit, ("fill", "good", "marginal", "snow_ice", "cloudy"))), F.col("pixel_reliability").cast("int") + 2)
    lower = F.lower("land_water")
    land = F.when(lower.contains("shallow"), "shallow_water").when(lower.contains("shore"), "shoreline").when(lower.contains("land"), "land").otherwise("water")
    in_range = F.col("ndvi_raw").between(-2000, 10000)
    qc = F.when(in_range & F.col("pixel_reliability").isin(0, 1), F.col("ndvi_raw") * 1e-4)
    return raw.withColumns({"observation_date": observed, "quality_class": quality, "land_water_class": land, "ndvi_qc": qc, "ndvi_land_qc": F.when(land == "land", qc)})


def geos_files(paths: DataFrame) -> DataFrame:
    """Quarter-hour files from their names: start, end and satellite longitude; of repeats the first path counts."""
    name = F.element_at(F.split("path", "/"), -1)
    stamp = lambda k: F.try_to_timestamp(F.regexp_extract(name, r"_(\d{14})_(\d{14})_", k), F.lit("yyyyMMddHHmmss"))
    x = paths.select("path", stamp(1).alias("start"), stamp(2).alias("end"), (F.regexp_extract(name, r"_(\d{4})[EB]_", 1).try_cast("int") / 10).alias("sat_lon")).filter("start IS NOT NULL")
    x = x.filter((F.unix_timestamp("end") - F.unix_timestamp("start")).between(800, 900))
    first = F.row_number().over(Window.partitionBy("start", "sat_lon").orderBy("path"))
    return x.withColumn("__rn", first).filter("__rn = 1").drop("__rn")


def hourly_quality(files: DataFrame, begin: str, end: str) -> DataFrame:
    """One row an expected hour: complete with the four quarter-hour segments."""
    spark = files.sparkSession
    axis = spark.sql(f"SELECT explode(sequence(TIMESTAMP '{begin}', TIMESTAMP '{end}', INTERVAL 1 HOUR)) AS hour")
    met = files.groupBy(F.date_trunc("hour", "start").alias("hour")).agg(F.array_sort(F.collect_set(F.minute("start"))).alias("minutes"))
    return axis.join(met, "hour", "left").withColumn("complete", F.coalesce(F.col("minutes") == F.array(*map(F.lit, (0, 15, 30, 45))), F.lit(False)))


def raster_xyz(spark: SparkSession, path: str, nodata: float = -9999.0) -> DataFrame:
    """(row, col, x, y, z) of a text raster, north up; void cells are NULL."""
    p = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).filter(F.trim("value") != "").select(*(p[i].cast("double").alias(n) for i, n in enumerate("xyz")))
    xs = x.select("x").distinct().withColumn("col", F.row_number().over(Window.orderBy("x")))
    ys = x.select("y").distinct().withColumn("row", F.row_number().over(Window.orderBy(F.desc("y"))))
    return x.join(xs, "x").join(ys, "y").select("row", "col", "x", "y", F.when(F.col("z") != nodata, F.col("z")).alias("z"))


def request_rows(stations: DataFrame, variables: list[str], years: list[int]) -> DataFrame:
    """One JSON request a station for the reanalysis service; sending it is not part of this package."""
    body = F.struct(F.array(*map(F.lit, variables)).alias("variable"), F.struct(F.col("lon").alias("longitude"), F.col("lat").alias("latitude")).alias("location"), F.array(F.lit(f"{min(years)}-01-01/{max(years)}-12-31")).alias("date"), F.lit("csv").alias("data_format"))
    return stations.select("station_id", F.to_json(body).alias("request"))
