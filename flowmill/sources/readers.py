"""Scans of source formats into long tables, with explicit schemas and strict parsing."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def european_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolons and decimal commas. Doubles are read as decimals first: a double column would turn
    ``0,315`` into NULL."""
    wanted = T._parse_datatype_string(schema)
    read = T.StructType([T.StructField(f.name, T.DecimalType(38, 18) if isinstance(f.dataType, T.DoubleType) else f.dataType) for f in wanted])
    df = spark.read.csv(path, sep=";", header=True, schema=read, locale="de-DE", mode="FAILFAST", enforceSchema=False)
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))


def catalog_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All text, trimmed, empty cells kept; the header must be exactly the expected one."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False, nullValue="\0", emptyValue="")
    return df.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in columns))


def wide_block(spark: SparkSession, path: str, n_label_columns: int, column_labels: list[tuple[str, str]], sep: str = "\t", header_rows: int = 0) -> DataFrame:
    """A labelled matrix block as (o_country, o_sector, d_country, d_sector, value): row labels in the
    first columns, column labels given in order. Lines stay distributed; cells come by posexplode."""
    text = spark.read.text(path)
    parts = F.split("value", sep)
    labels = F.array(*(F.struct(F.lit(c).alias("d_country"), F.lit(s).alias("d_sector")) for c, s in column_labels))
    rows = text.where(F.size(parts) == n_label_columns + len(column_labels)).select(parts.alias("p"))
    for _ in range(header_rows):
        rows = rows.where(F.try_element_at(F.col("p"), F.lit(n_label_columns + 1)).cast("string").rlike(r"^\s*[-+0-9.]"))
    cells = rows.select(F.col("p")[0].alias("o_country"), F.col("p")[n_label_columns - 1].alias("o_sector"), F.posexplode(F.slice("p", n_label_columns + 1, len(column_labels))).alias("k", "v"))
    return cells.select("o_country", "o_sector", F.element_at(labels, F.col("k") + 1).alias("d"), F.col("v").cast("double").alias("value")).select("o_country", "o_sector", "d.d_country", "d.d_sector", "value")


def filtered_csv(spark: SparkSession, path: str, condition: str | Column, **options) -> DataFrame:
    return spark.read.csv(path, header=True, **options).where(condition)


def indicator_pull(df: DataFrame, start_year: int, countries: list[str]) -> DataFrame:
    """A landed indicator table restricted to years and countries."""
    return df.where((F.col("year") >= start_year) & F.col("iso2c").isin(countries))


def override(base: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """A later release replaces the cells that it has."""
    return base.join(later.select(*keys).distinct(), keys, "left_anti").unionByName(later)


def coefficients_file(spark: SparkSession, path: str, sectors: list[str], years: list[int], low: float = 0.0, high: float = 8.784) -> DataFrame:
    """(year, sector, coefficient) of a wide file (setor; code; years): exact columns and labels in
    order, values within a range; anything else aborts."""
    schema = "setor string, code string, " + ", ".join(f"`{y}` double" for y in years)
    df = european_csv(spark, path, schema)
    got = [r.code for r in df.select("code").collect()]
    if got != sectors:
        raise ValueError("sector codes differ from the expected ones or their order")
    out = df.unpivot(["code"], [str(y) for y in years], "year", "coefficient").select(F.col("year").cast("int").alias("year"), F.col("code").alias("sector"), "coefficient")
    bad = out.where(F.col("coefficient").isNull() | (F.col("coefficient") < low) | (F.col("coefficient") > high))
    if not bad.isEmpty():
        raise ValueError("coefficient missing or out of range")
    return out


def check_file(path: str | Path, size: int | None = None, digest: str | None = None, algorithm: str = "sha256", validator=None) -> None:
    """Exact size, digest and an own test of a landed file."""
    p = Path(path)
    if size is not None and p.stat().st_size != size:
        raise ValueError(f"{p.name}: {p.stat().st_size} bytes, not {size}")
    if digest is not None:
        with open(p, "rb") as f:
            if hashlib.file_digest(f, algorithm).hexdigest() != digest:
                raise ValueError(f"{p.name}: wrong {algorithm}")
    if validator is not None:
        validator(p)


def landed(url: str, path: str | Path, fetch, size: int | None = None, digest: str | None = None, algorithm: str = "sha256", validator=None) -> Path:
    """A verified download: a good file is used again; else ``fetch(url, temporary path)`` is called
    and the file is moved into place once it passes."""
    p = Path(path)
    if p.exists():
        try:
            check_file(p, size, digest, algorithm, validator)
        except ValueError:
            pass
        else:
            return p
    tmp = p.with_name(f".{p.name}.part")
    try:
        fetch(url, tmp)
        check_file(tmp, size, digest, algorithm, validator)
        tmp.replace(p)
    finally:
        tmp.unlink(missing_ok=True)
    return p


def check_zip(path: str | Path, members: list[str]) -> None:
    with zipfile.ZipFile(path) as z:
        sizes = {i.filename: i.file_size for i in z.infolist()}
    wrong = [m for m in members if not sizes.get(m)]
    if wrong:
        raise ValueError(f"missing or empty members {wrong}")


def write_bundle(df: DataFrame, path: str) -> dict:
    """Parquet with a sidecar (schema, rows, order-free content hash), checked by reading back."""
    df.write.mode("error").parquet(path)
    back = df.sparkSession.read.parquet(path)
    meta = _meta(back)
    if meta != _meta(df):
        raise ValueError("what was written differs from what was read back")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}.meta")
    return meta


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Reads a bundle after comparing it with its sidecar."""
    want = json.loads(spark.read.text(f"{path}.meta").first().value)
    df = spark.read.parquet(path)
    if _meta(df) != want:
        raise ValueError(f"{path}: content differs from its sidecar")
    return df


def _meta(df: DataFrame) -> dict:
    cols = sorted(df.columns)
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0)).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(1 << 30))).alias("s")).first()
    return {"rows": row.n, "xor": row.x, "sum": row.s or 0, "columns": {f.name: f.dataType.simpleString() for f in sorted(df.schema, key=lambda f: f.name)}}


def write_result_csv(df: DataFrame, path: str) -> None:
    """One UTF-8 file with semicolons, for result tables of label size, compared after reading it back.
    Missing cells are empty, so a table with empty texts, which would come back as missing, is refused."""
    text = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    text.coalesce(1).write.mode("error").csv(path, sep=";", header=True, encoding="UTF-8")
    back = df.sparkSession.read.csv(path, sep=";", header=True, schema=text.schema, encoding="UTF-8")
    if _meta(back) != _meta(text):
        raise ValueError(f"{path}: what was written differs from what was read back")


def artifact_errors(spark: SparkSession, path: str, patterns: list[str], manifest: list[str]) -> DataFrame:
    """(file, problem) of the files below ``path`` that match a pattern against the manifest's names.
    Files are listed; their contents aren't read."""
    found = None
    for p in patterns:
        part = spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
        found = part if found is None else found.unionByName(part)
    wanted = spark.createDataFrame([(m,) for m in manifest], "file string")
    both = found.distinct().withColumn("have", F.lit(True)).join(wanted.withColumn("want", F.lit(True)), "file", "full")
    return both.where("have is null or want is null").select("file", F.when(F.col("have").isNull(), "missing").otherwise("not in manifest").alias("problem"))


def append_report(rows: DataFrame, path: str) -> DataFrame:
    """Appends anomaly rows to a Parquet report and returns the whole report."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
