"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kept in memory and on executors' disks; what a lost executor held is computed again from its lineage.
KEEP = StorageLevel.MEMORY_AND_DISK


def cut(df: DataFrame) -> DataFrame:
    """The rows, written under spark.checkpoint.dir (shared by the cluster), without their lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"/tmp/checkpoints/{uuid.uuid4().hex}")  # one machine: every folder is shared
    return df.checkpoint()


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions: given to repartition(), it keeps a table dealt by its key as it is."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` of the rows, the first ones by a hash of the key; few more than that are sorted."""
    share = 1.2 * most / max(1, rows.count())
    return rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64(key), *rows.columns).limit(most)


def same(left: Column, right: Column) -> Column:
    """Equality that holds for two nulls as well."""
    return left.eqNullSafe(right)


def columns_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """Just the named columns, cast to the given types; a missing one is null. Other columns are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
