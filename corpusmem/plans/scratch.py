"""Intermediate tables in the folder that all executors share, for results that a plan reads more than once."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master (tests) may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: intermediates need a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="corpusmem-")
    return _local["dir"]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: lineage ends there, a lost executor loses nothing, and the plans above stay
    small. The table is removed when the driver ends, or by clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Removes all tables stored so far; results that still read them can't be read any more."""
    while _made:
        with contextlib.suppress(Exception):  # the session may have ended
            remove(*_made.pop())
