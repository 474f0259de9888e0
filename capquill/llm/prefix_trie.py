"""Conversation prefix trie (operator 11): level-synchronous construction, then a rollup from the deepest level.

A round takes the live conversations one turn further: they are grouped by (parent node, digest of the next turn), and each
group is a node that is named by its depth and its smallest conv_id. A conversation that has a node for itself leaves the
rounds: all that follows is a chain of nodes of one member, which its length tells. So there are as many rounds as turns that
any two conversations share. Going back, each level's leaves and savings are summed into the level above.

Turns travel as a digest (SHA-256 of role and text, with the role's length) and a number of words, one row each; no
conversation is ever put together in a row. Positions come from a range partitioning over (conv_id, turn, digest), so that a
conversation may lie in many tasks. Nodes and conversations that hold a large part of the rows are looked up by broadcast
(fewer than HEAVIEST of them can), the others by a shuffle. The digest of the members that end at a node is taken over
blocks of conv_ids that are joined beforehand.

Nulls and ties: rows with a null conv_id belong to no conversation and are left out; a null role or text is an empty one; null
turns come first, and turns of equal number go by the digest of role and text; repeated rows are turns each. Of negative
conv_ids the remainder keeps the sign (-7 % 20 is -7). A conversation without turns is a member of the root. An empty table
gives no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capquill.llm.common import KEEP, columns_or_null, cut, partitions, table

WORD = r"[^\x20\x09-\x0D]+"
#: The rebuilding: conversations borrow from each BORROWED-th one, fewer than TAKEN turns.
BORROWED, TAKEN = 20, 4
#: A key of more than LIGHT rows, and of more than a HEAVIEST-th of all, is looked up by broadcast.
LIGHT, HEAVIEST = 1_000, 10_000
#: Depths of a chain that are made from a row, conv_ids in a block (as a power of 2), and levels kept apart.
CHAIN, BLOCK_BITS, APART = 10_000, 13, 24
EMPTY = hashlib.sha256().hexdigest()


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows with the other columns of `found` (unique by the keys), null where there is none; `weight` tells how many rows a key has."""
    heavy = F.col(weight) > max(LIGHT, total / HEAVIEST)
    value = F.struct(*[c for c in found.columns if c not in (*on, weight)])
    few = F.broadcast(found.where(heavy).select(*on, value.alias("heavy")))
    many = found.where(~heavy).select(*on, F.lit(0).alias("salt"), value.alias("light"))
    # Rows that are found already meet nobody in the shuffle, and are dealt evenly.
    salt = F.when(F.col("heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)).cast("int"))
    out = rows.join(few, on, "left").withColumn("salt", salt).join(many, [*on, "salt"], "left")
    return out.select(*rows.columns, F.coalesce("heavy", "light").alias("found")).select(*rows.columns, "found.*")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_key, words of every turn."""
    c = columns_or_null(conversations, conv_id="bigint", turn="bigint", role="string", text="string").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    c = c.select("conv_id", "turn", key.alias("turn_key"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    order = [F.asc_nulls_first("turn"), F.col("turn_key")]
    dealt = c.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(c), F.col("conv_id"), *order, F.col("row"))
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()).drop("row"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(before))
    later = F.broadcast(sizes.where("before is not null").drop("count"))  # at most one conversation goes on in each part
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    ranked = dealt.withColumn("rank", rank).join(later, ["conv_id", "part"], "left")
    return ranked.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: (conv_id, length) of each, and (conv_id, depth, turn_key, words) of each turn."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumn("base", F.expr(f"conv_id - conv_id % {BORROWED}")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % TAKEN)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(lengths, "base", "left").withColumn("taken", taken)
    convs = cut(convs.select("conv_id", "base", "h", "n", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")))
    heads = turns.where(F.col("pos") < TAKEN).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos <= taken")
    total = convs.agg(F.sum("n")).first()[0] or 0
    # Most own turns keep their position: only where the other conversation is too short do they move up.
    moved = convs.where("taken < h").select("conv_id", "n", (F.col("taken") - F.col("h")).alias("shift"))
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % TAKEN).where("pos > h").drop("h")
    own = looked_up(own, moved, ["conv_id"], "n", total).withColumn("pos", F.col("pos") + F.coalesce("shift", F.lit(0)))
    columns = ["conv_id", F.col("pos").alias("depth"), "turn_key", "words"]
    return convs.select("conv_id", "length"), heads.select(*columns).unionByName(own.select(*columns))


class Levels:
    """Rows of many levels; every so often they are written as one table."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) >= APART:
            self.parts = [cut(self.all().coalesce(partitions(df)))]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks, which come one after another, joined by commas."""
    node, digest = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            now = (row["depth"], row["conv_id"])
            if now != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row["ids"].encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "ends_sha256"), x, strict=True)) for x in done], ENDS)
    if node:
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "ends_sha256"), (*node, digest.hexdigest()), strict=True))], ENDS)


ENDS = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of each node (depth, node) at which conversations (member) end."""
    block = ends.groupBy("depth", "node", F.shiftright("member", BLOCK_BITS).alias("block"))
    blocks = block.agg(F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = blocks.withColumnRenamed("node", "conv_id").repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "block")
    return dealt.select("depth", "conv_id", "ids").mapInArrow(_digests, "depth bigint, conv_id bigint, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, length) whose turns are rows (conv_id, depth from 1, turn_key, words)."""
    turns = cut(turns)
    session = convs.sparkSession
    root, total = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not total:
        return session.createDataFrame([], SCHEMA)
    live = convs.withColumn("node", F.lit(root).cast("bigint"))
    top = session.createDataFrame([(root, None, total, 0)], "conv_id bigint, parent bigint, n_convs bigint, words bigint")
    nodes, alone, ends, chains, depth = [top], [], Levels(), Levels(), 0
    while total:
        at = F.lit(depth).cast("bigint")
        ends.add(live.where(F.col("length") == depth).select(at.alias("depth"), "node", F.col("conv_id").alias("member")))
        going = live.where(F.col("length") > depth).join(turns.where(F.col("depth") == depth + 1).drop("depth"), "conv_id").persist(KEEP)
        groups = going.groupBy("node", "turn_key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
        shared = cut(groups.where("n_convs > 1"))
        moved = cut(looked_up(going.drop("words"), shared.drop("words"), ["node", "turn_key"], "n_convs", total).drop("turn_key"))
        going.unpersist()
        single = moved.where("child is null").select("conv_id", "node", "length", at.alias("left_at"))
        chains.add(single)
        alone.append(single.groupBy("node").agg(F.count("*").alias("singles")))
        nodes.append(shared.select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), "n_convs", "words"))
        live = moved.where("child is not null").select("conv_id", "length", F.col("child").alias("node"))
        total = shared.agg(F.sum("n_convs")).first()[0] or 0
        depth += 1
    return _rolled_up(nodes, alone, ends, chains)


def _rolled_up(nodes: list[DataFrame], alone: list[DataFrame], ends: Levels, chains: Levels) -> DataFrame:
    rolled, below = Levels(), None
    for depth in range(len(alone) - 1, -1, -1):  # the last round found no shared node
        kids = alone[depth].select("node", F.col("singles").alias("n_children"), F.col("singles").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("node"))
            kids = kids.unionByName(sums.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        kids = kids.groupBy(F.col("node").alias("conv_id")).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        own = (F.col("n_convs") - 1) * F.col("words")
        below = nodes[depth].join(kids, "conv_id", "left").select(
            "conv_id",
            F.lit(depth).cast("bigint").alias("depth"),
            "parent",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (own + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
        )
        below = cut(below)
        rolled.add(below)
    shared = rolled.all().join(ends_digests(ends.all()), ["depth", "conv_id"], "left")
    return shared.selectExpr(*OUT).unionByName(_chains(chains.all()))


SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
OUT = ["conv_id", "depth", "parent as parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", f"coalesce(ends_sha256, '{EMPTY}') as ends_sha256"]


def _chains(single: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, length) that left the node (left_at, node) alone: one for each further turn."""
    from_, last = F.col("left_at") + 1, F.col("length")
    stretch = single.withColumn("first", F.explode(F.sequence(from_, last, F.lit(CHAIN).cast("bigint")))).repartition("conv_id", "first")
    each = stretch.withColumn("depth", F.explode(F.sequence("first", F.least(last, F.col("first") + CHAIN - 1))))
    leaf, one = F.col("depth") == last, F.lit(1).cast("bigint")
    return each.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == from_, F.col("node")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(leaf, 0).otherwise(1).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(leaf, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = cut(numbered(conversations))
    return trie(turns.groupBy("conv_id").agg(F.max("pos").alias("length")), turns.withColumnRenamed("pos", "depth"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose first turns are those of another one."""
    return trie(*rebuilt(cut(numbered(conversations))))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal: each character is added, then eight times a bit is shifted out.
_CRC = """xor(list_reduce(flatten([[4294967295]] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""

ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, conv_id - conv_id % {BORROWED} AS base, {_CRC} % {TAKEN} AS h FROM (SELECT DISTINCT conv_id FROM t)
), u AS (
  SELECT c.conv_id, 0 AS part, pos, r, x FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), s AS (
  SELECT c.conv_id, coalesce(list({{'r': r, 'x': x}} ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS turns
  FROM c LEFT JOIN u ON c.conv_id = u.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, depth, len(turns) AS length, min(conv_id) OVER (PARTITION BY depth, turns[1:depth]) AS node,
         CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].x, '{WORD}')) ELSE 0 END AS words
  FROM s, unnest(range(0, len(turns) + 1)) AS g(depth)
), n AS (
  SELECT depth, node, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, node
), e AS (SELECT n.*, q.node AS parent FROM n LEFT JOIN p q ON q.conv_id = n.node AND q.depth = n.depth - 1
), k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY ALL
), w AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN k ON e.depth = k.depth AND e.node = k.node
), a AS (
  SELECT q.depth, q.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
  FROM w JOIN p q ON q.conv_id = w.node AND q.depth <= w.depth GROUP BY q.depth, q.node
)
SELECT w.node AS conv_id, w.depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM w JOIN a ON w.depth = a.depth AND w.node = a.node
"""
