"""Connected components by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum per node and a join back by another form of the key, so that both sides are
dealt for the join and a node with very many neighbours can be split; edges are cut from their lineage after each round and only their number and a checksum reach the
driver. Ends when a round changes nothing, after a number of rounds that grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capquill.llm.common import cut


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for each node u that is not the least of its component, whose least node is v."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("key"), F.least("u", "m").alias("m"))
        edges = both.join(least, F.bitwise_not("u") == F.col("key")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        up = edges.join(least.select(F.bitwise_not("u").alias("key"), "m"), F.bitwise_not("u") == F.col("key")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = up.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = cut(up.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = _print(edges)
        if now == seen:
            return edges
        seen = now
