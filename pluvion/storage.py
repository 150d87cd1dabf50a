"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: ``spark.checkpoint.dir``.

    Where that is unset, a local master (one machine) gets a temporary folder; a cluster gets an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='pluvion-')}")
            atexit.register(shutil.rmtree, _LOCAL[0].removeprefix("file://"), ignore_errors=True)
        base = _LOCAL[0]
    return qualified(spark, base)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
