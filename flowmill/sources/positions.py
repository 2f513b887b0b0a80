"""Sources whose labels are given by position: numbered lines, labelled blocks, arrays in column-major order."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of the text files below ``path``, numbered from 0 in the order of file names and lines.

    Files are read in splits. Lines are numbered within their split, and splits get offsets from the counts of those
    before them, so no task holds more than a split and the numbers don't depend on how files are cut.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).groupBy("file", "block").agg(F.count("*").alias("n"))
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row a split
    own = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    return rows.withColumn("own", own).join(offsets, ["file", "block"]).select((F.col("offset") + F.col("own")).alias("line"), "value")


def label_file(spark: SparkSession, path: str, fields: dict[str, int], sep: str = "\t") -> DataFrame:
    """(pos, fields...) of a label file: ``fields`` maps names to places in a line."""
    parts = F.split("value", sep)
    return numbered_lines(spark, path).select(F.col("line").alias("pos"), *(F.trim(F.get(parts, F.lit(i))).alias(n) for n, i in fields.items()))


def positioned_block(spark: SparkSession, path: str, rows: DataFrame, columns: DataFrame, drop: str | None = "ROW", scale: float = 1.0, sep: str = "\t") -> DataFrame:
    """A block of numbers without labels as (row labels..., column labels..., value x scale).

    ``rows``, ``columns``: from ``label_file``, whose columns must have names of their own and hold ``o_country`` and
    ``d_country``; labels of ``drop`` fall out on both sides. Another number of lines than row labels, a line with another number
    of cells than column labels, and a cell that is no number are errors.
    """
    n = columns.count()
    lines = numbered_lines(spark, path)
    both = rows.withColumnRenamed("pos", "line").join(lines, "line", "full")
    off = F.col("value").isNull() | F.col("o_country").isNull() | (F.size(F.split("value", sep)) != n)
    cells = F.when(off, F.raise_error(F.concat(F.lit("line without its label, or of another length: "), F.col("line"))).cast("array<string>")).otherwise(F.split("value", sep))
    kept = both.withColumn("cells", cells).where(F.lit(True) if drop is None else ~F.col("o_country").eqNullSafe(drop))
    names = [c for c in rows.columns if c != "pos"]
    wide = kept.select(*names, F.posexplode("cells").alias("pos", "text"))
    there = columns if drop is None else columns.where(F.col("d_country") != drop)
    number = F.col("text").try_cast("double")
    value = F.when(number.isNull(), F.raise_error(F.concat(F.lit("no number: "), F.col("text"))).cast("double")).otherwise(number * scale)
    return wide.join(there.withColumn("pos", F.col("pos").cast("int")), "pos").select(*names, *(c for c in columns.columns if c != "pos"), value.alias("value"))


def encoded(cells: DataFrame, axes: dict[str, list], value: str = "value") -> DataFrame:
    """(pos, value) of every place of an array in column-major order: the first axis runs fastest. Absent cells are null."""
    grid = None
    for name, labels in axes.items():
        side = _axis(cells.sparkSession, name, labels, dict(cells.dtypes)[name])
        grid = side if grid is None else grid.crossJoin(side)  # labels alone
    stride, pos = 1, F.lit(0).cast("long")
    for name, labels in axes.items():
        pos, stride = pos + F.col(f"{name}__i") * stride, stride * len(labels)
    return grid.withColumn("pos", pos).join(cells.select(*axes, value), list(axes), "left").select("pos", F.col(value).alias("value"))


def decoded(values: DataFrame, axes: dict[str, tuple[list | None, str]], size: list[int]) -> DataFrame:
    """(axes..., value) of (pos, value) by the array's ``size``. ``axes``: labels and type of each; labels that a sidecar lacks
    (None) are numbers from 1. Another number of values than places, and a place out of range or taken twice, is an error."""
    if len(axes) != len(size) or any(labels is not None and len(labels) != n for (labels, _), n in zip(axes.values(), size)):
        raise ValueError("labels don't fit the size of the array")
    told = values.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
    places = prod(size)
    if tuple(told) != (places, places, 0 if places else None, places - 1 if places else None):
        raise ValueError(f"{told[0]} values at {told[1]} places from {told[2]} to {told[3]}, for an array of {places}")
    out, stride = values, 1
    for (name, (labels, kind)), n in zip(axes.items(), size):
        i = F.floor(F.col("pos") / stride) if stride > 1 else F.col("pos")
        out, stride = out.withColumn(f"{name}__i", F.pmod(i.cast("long"), F.lit(n))), stride * n
        out = out.withColumn(name, (F.col(f"{name}__i") + 1).cast(kind)) if labels is None else out.join(_axis(values.sparkSession, name, labels, kind), f"{name}__i")
    return out.select(*axes, "value")


def _axis(spark: SparkSession, name: str, labels: list, kind: str) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(labels)], f"{name}__i long, {name} {kind}").coalesce(1)
