"""Connected components by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import cut_lineage


def _smallest_neighbour(directed: DataFrame) -> DataFrame:
    """(u, v, m) where m is the smallest of u and all its neighbours.

    An aggregate and a join instead of a window: the aggregate combines before its shuffle and the
    join can be split, so a hub with many neighbours does not meet in one task.
    """
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return directed.join(least, "u")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of ``edges`` that is not the smallest of its component; root is the smallest.

    Null ends and loops are ignored. The number of rounds grows with the logarithm of the longest
    path; each round is written to the shared folder.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # Each edge points from its larger end u to its smaller end v.
    now = cut_lineage(ends.select(high.alias("u"), low.alias("v")).distinct())
    before = _signature(now)
    while before[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _smallest_neighbour(large)
        now = cut_lineage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        )
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
