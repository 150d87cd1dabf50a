"""Writers: wide tables, yearly partitions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide(panel: DataFrame, ids: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """time and one column a station, sorted by id."""
    value = F.first("value") if digits is None else F.round(F.first("value"), digits)
    return panel.groupBy("time").pivot("station_id", sorted(ids) if ids else None).agg(value).orderBy("time")


def write_wide(panel: DataFrame, path: str, ids: list[str] | None = None) -> None:
    wide(panel, ids).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")).write.mode("errorifexists").csv(path, header=True)


def write_years(panel: DataFrame, path: str) -> None:
    """Parquet by UTC year, stations together within a year."""
    panel.withColumn("utc_year", F.year("time")).repartition("utc_year").sortWithinPartitions("station_id", "time").write.partitionBy("utc_year").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A result table as CSV; arrays are joined by semicolons."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.csv(path, header=True)


def write_tables(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Result tables of a run (selection, terrain, joint, status), each as CSV under its name; gives the paths."""
    for name, rows in tables.items():
        write_report(rows, f"{path}/{name}")
    return [f"{path}/{name}" for name in tables]


def provenance(spark, settings: dict, sources: dict[str, str], repository: str | None = None) -> DataFrame:
    """(item, value): settings, digests of source files, and the commit that a repository's HEAD names (unknown where it has none)."""
    rows = [(f"setting:{k}", str(v)) for k, v in sorted(settings.items())]
    for name, path in sorted(sources.items()):
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()
        rows.append((f"sha256:{name}", found[0]["d"] if found else "missing"))
    return spark.createDataFrame([*rows, ("commit", _commit(repository))], "item string, value string")


def _commit(repository: str | None) -> str:
    try:
        with open(f"{repository}/.git/HEAD") as f:
            head = f.read().strip()
        if not head.startswith("ref: "):
            return head
        with open(f"{repository}/.git/{head[5:]}") as f:
            return f.read().strip()
    except OSError:
        return "unknown"
