"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are aggregations and joins on node ids, so nothing is gathered; the number of rounds
grows with the logarithm of the longest path. Every round is written to the shared folder, which
cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v) with u > v. Links what a node sees to the smallest node it sees."""
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: for every node of ``edges`` the smallest node reachable from it.

    Loops and repeated edges are ignored; an empty table gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = saved(now, "edges")
    mark = None
    while True:
        new = saved(_stars(_stars(now, large=True), large=False), "edges")
        row = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row.n, row.x) == mark or row.n == 0:
            break
        mark, now = (row.n, row.x), new
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
