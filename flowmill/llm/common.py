"""Helpers shared by the operators: table access, the shared folder, file access from tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names no such folder gets a temporary one; elsewhere its absence is
    an error, because executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="flowmill-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str, by: tuple[str, ...] = (), instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and losses stay local.

    ``by``: columns that the folder is partitioned by. ``instead_of``: a saved table that nothing
    but ``df`` was made from; its files are removed once ``df`` is written.
    """
    path = shared_dir(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(path)
    if instead_of is not None:
        removed(instead_of)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Removes the folder of a saved table (without partition columns)."""
    for file in df.inputFiles()[:1]:
        where, path = filesystem(file.rsplit("/", 1)[0])
        where.delete_dir(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets Arrow batches to at most ``rows`` rows, so that a worker holds few texts at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a folder, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name`` made unique among the columns of ``df``, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
