"""Sharding (operator 8): byte balance by Karmarkar-Karp differencing over groups of equal texts.

Groups are weighed by a pre-aggregated sum and dealt into blocks by a hash. Each block, of a bounded number
of groups, is solved by differencing: the two partial partitions with the largest spread are combined in
opposite order until one is left. Blocks are then combined by the same rule, in a tree of bounded fan-in,
where only their shard sums travel; the permutations lead back to the groups. Law: `bytes`.

Nulls and ties: a null text has size 8 (as an empty one) and forms a group of its own, apart from empty
texts; a null doc_id is a row like any other and sorts first; repeated rows each get a slot. Ties are
broken by position in the block. An empty table gives no rows; other columns of the input are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capquill.llm.common import KEEP, columns_or_null, table

SHARDS = 24
#: Groups in a block, partial partitions that one task combines, and rows in a bucket of slots.
BLOCK, FAN, SLOTS = 20_000, 1_000, 200_000


def differencing(parts: Sequence[Sequence[int]], shards: int) -> list[list[int]]:
    """For each partial partition (up to `shards` sums), the shard that each of its sums goes to."""
    heap = []
    for i, sums in enumerate(parts):
        full = sorted(((w, (i, j)) for j, w in enumerate([*sums, *[0] * (shards - len(sums))])), key=lambda x: -x[0])
        heap.append((full[-1][0] - full[0][0], i, full))
    heapq.heapify(heap)
    seen = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        low = joined[-1][0]
        joined = [(w - low, m) for w, m in joined]
        heapq.heappush(heap, (-joined[0][0], seen, joined))
        seen += 1
    out = [[0] * shards for _ in parts]
    for shard, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            left, right = stack.pop()
            if isinstance(left, int):
                out[left][right] = shard
            else:
                stack += (left, right)
    return out


def _solve_block(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["weight", "group"], ascending=[False, True])
    solved = differencing([[int(w)] for w in pdf["weight"]], shards)
    return pdf.assign(label=[s[0] for s in solved])[["block", "group", "label", "weight"]]


def _combine(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    pdf = pdf.sort_values("item")
    return pdf.assign(moves=differencing(pdf["sums"].tolist(), shards))[["parent", "item", "moves", "sums"]]


def _sums(labelled: DataFrame, item: str, shards: int) -> DataFrame:
    total = labelled.groupBy(item, "label").agg(F.sum("weight").alias("weight"))
    by = total.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("m"))
    return by.select(F.col(item).alias("item"), F.array(*[F.coalesce(F.col("m")[k], F.lit(0)) for k in range(shards)]).alias("sums"))


def group_shards(groups: DataFrame, shards: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """group, shard for rows of (group, weight)."""
    blocks = max(1, -(-groups.count() // block))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)))
    labelled = dealt.groupBy("block").applyInPandas(lambda p: _solve_block(p, shards), "block bigint, group binary, label int, weight bigint").persist(KEEP)
    placed = labelled.withColumnRenamed("block", "item")
    while True:
        parents = -(-blocks // fan)
        moved = _sums(placed, "item", shards).withColumn("parent", F.pmod("item", F.lit(parents)))
        moved = moved.groupBy("parent").applyInPandas(lambda p: _combine(p, shards), "parent bigint, item bigint, moves array<int>, sums array<bigint>")
        placed = placed.join(moved.select("item", "parent", "moves"), "item").select(F.col("parent").alias("item"), "group", F.col("moves")[F.col("label")].alias("label"), "weight")
        if parents == 1:
            return placed.select("group", F.col("label").alias("shard"))
        placed, blocks = placed.persist(KEEP), parents


def slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """placed with slot: positions from 0 without gaps in each shard; shards are numbered in buckets, none as a whole."""
    buckets = max(1, -(-placed.count() // SLOTS))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("from"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(*order)) - 1
    return placed.withColumn("rank", rank).join(sizes, ["shard", "bucket"]).withColumn("slot", F.col("from") + F.col("rank")).drop("rank", "from", "bucket")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each document."""
    d = columns_or_null(docs, doc_id="bigint", text="string").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"null")).alias("group"),
    ).persist(KEEP)
    groups = d.groupBy("group").agg(F.sum("size").alias("weight"))
    placed = d.join(group_shards(groups, shards), "group").persist(KEEP)
    return slots(placed, ["doc_id", "group"]).drop("group")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
