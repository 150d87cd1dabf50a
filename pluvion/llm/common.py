"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pluvion.session import ship
from pluvion.storage import materialise, qualified, scratch, shared_dir  # noqa: F401  the operators' names for them

#: ASCII white space; what lies between is a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system, as idle worker processes stay beside the busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def settle() -> None:
    """Give back what the driver no longer needs after a fit: arrays that waited for the collector, and freed memory."""
    gc.collect()
    give_back()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialise`` with a stronger compression, and the path, for what ``freed`` is to delete."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def freed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that are used up, and let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    spark._jvm.System.gc()


#: Rows of a batch that a worker's function sees; texts may be long (Spark bounds a batch's bytes besides).
BATCH_ROWS = 2_000


def arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with this package available on the workers, in batches of few rows; the session's settings stay."""
    ship(df.sparkSession)

    def few(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(a, BATCH_ROWS)

    def run(batches):
        try:
            yield from function(few(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """What a worker process keeps from task to task; only one thing at a time, so that operators don't add up."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


class Cache(dict):
    """word -> value, filled on demand by ``make`` and emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; bytes.lower and bytes.split touch ASCII only, as the definition asks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
