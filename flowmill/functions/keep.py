"""Tables that a calculation reads many times, written once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables kept within each open ``released`` block.
_OPEN: list[list[str]] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a local session that names no such folder gets a temporary one; elsewhere its absence is an
    error, because executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="flowmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a shared path and read back.

    For aggregates of label size that many branches of a plan read: they are computed once, lost
    executors cost nothing, and plans stay short.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    for block in _OPEN[-1:]:
        block.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Removes the folder of a kept table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        deleted(df.sparkSession, file.rsplit("/", 1)[0])


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was kept within it, so results must have been written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            deleted(spark, path)
