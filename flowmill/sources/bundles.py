"""Bundles and source generations: Parquet with a hash of every part file, taken in tasks.

A bundle's folder holds its part files and, in ``_bundle``, a manifest: a line a file with size and SHA-256, and the
table's schema and rows. It is made in a folder beside, verified there, and put into place by renames; if that
fails the old bundle is put back. A part file must be below 2 GB, as one row holds it while it is hashed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "file string, size long, sha256 string, rows long, schema string"
GENERATION = "file string, size long, modified timestamp, sha256 string"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def moved(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _fs(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, size, modified, content) of the files below ``path``, named from there; columns that aren't used aren't read."""
    fs, where = _fs(spark, path)
    root = fs.makeQualified(where).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return rows.select(F.substring_index("path", root + "/", -1).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("file", "size", F.sha2("content", 256).alias("sha256"))


# ---------------------------------------------------------------- bundles


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/_bundle")


def damage(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of part files that differ from the manifest: changed, missing or unexpected; empty if sound."""
    want = manifest(spark, path).where("file is not null").select("file", F.struct("size", "sha256").alias("want"))
    both = hashed(files(spark, path)).select("file", F.struct("size", "sha256").alias("have")).join(want, "file", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def refuse(bad: DataFrame, path: str) -> None:
    first = bad.orderBy("file").limit(5).collect()
    if first:
        raise ValueError(f"{path}: " + "; ".join(f"{r.file} {r.problem}" for r in first))


def install(df: DataFrame, path: str, replace: bool = False) -> None:
    """Writes ``df`` as a bundle at ``path``. The old bundle, if ``replace`` allows one, stays until the new one is verified
    and is put back if it can't be put in place."""
    spark, mark = df.sparkSession, uuid.uuid4().hex[:12]
    if not replace and exists(spark, path):
        raise ValueError(f"{path} exists")
    stage, old = f"{path}.stage-{mark}", f"{path}.old-{mark}"
    try:
        df.write.parquet(stage)
        whole = spark.read.parquet(stage).agg(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("sha256"), F.count("*").alias("rows"), F.lit(df.schema.json()).alias("schema"))
        parts = hashed(files(spark, stage)).select("*", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("string").alias("schema"))
        whole.unionByName(parts).coalesce(1).write.json(f"{stage}/_bundle")
        refuse(damage(spark, stage), stage)
        had = exists(spark, path)
        if had:
            moved(spark, path, old)
        try:
            moved(spark, stage, path)
        except BaseException:
            if had:
                moved(spark, old, path)
            raise
        if had:
            removed(spark, old)
    finally:
        removed(spark, stage)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The table of a bundle whose files all have their hashes."""
    refuse(damage(spark, path), path)
    schema = StructType.fromJson(json.loads(manifest(spark, path).where("file is null").first().schema))
    return spark.read.schema(schema).parquet(path)


# ---------------------------------------------------------------- source generations


def scanned(spark: SparkSession, path: str, before: DataFrame | None = None) -> DataFrame:
    """The manifest (file, size, modified, sha256) of all files below ``path``. With the one of ``before``, only files of
    another size or time are read and hashed again; their names pass through the driver, which lists files anyway."""
    now = files(spark, path, recursive=True).select("file", "size", "modified")
    if before is None:
        return files(spark, path, recursive=True).select("file", "size", "modified", F.sha2("content", 256).alias("sha256"))
    same = now.join(before, ["file", "size", "modified"])
    fresh = [r.file for r in now.join(before, ["file", "size", "modified"], "left_anti").select("file").collect()]
    if not fresh:
        return same.select("file", "size", "modified", "sha256")
    content = files_named(spark, path, fresh)
    return same.select("file", "size", "modified", "sha256").unionByName(content)


def files_named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    fs, where = _fs(spark, path)
    root = fs.makeQualified(where).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{n}" for n in names])
    return rows.select(F.substring_index("path", root + "/", -1).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file, problem) between two manifests: added, removed or changed; a new time alone is no change."""
    both = before.select("file", F.col("sha256").alias("b")).join(now.select("file", F.col("sha256").alias("n")), "file", "full")
    return both.select("file", F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b") != F.col("n"), "changed").alias("problem")).where("problem is not null")


def generation_id(found: DataFrame) -> str:
    """Id of a generation: SHA-256 of names and hashes in the order of names, each with its length before it."""
    line = F.concat(F.length("file").cast("string"), F.lit(":"), F.col("file"), F.length("sha256").cast("string"), F.lit(":"), F.col("sha256"))
    rows = found.select(F.struct("file", line.alias("line")).alias("r"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n")
    return rows.agg(F.sha2(F.coalesce(joined, F.lit("")), 256)).first()[0]


def verified(spark: SparkSession, path: str, before: DataFrame, expected: str) -> None:
    """An error unless the files are those of the generation ``expected``, whose manifest is ``before``."""
    if generation_id(before) != expected:
        raise ValueError("the manifest is not that of the generation")
    refuse(changes(before, scanned(spark, path, before)), path)


def years_of(spark: SparkSession, path: str, column: str = "year") -> list[int]:
    """Years of a table partitioned by year, from the names of its folders: no job runs and no row is read."""
    fs, where = _fs(spark, f"{path}/{column}=*")
    return sorted(int(s.getPath().getName().split("=", 1)[1]) for s in fs.globStatus(where) or [])
