"""Substring dedup (operator 2): Rabin-Karp hashes of 35-word windows, counted in Spark.

Each window's rolling hash comes from prefix sums over word hashes. Windows whose anchor occurs once in the
corpus cannot repeat and are not shipped; of the others each run of windows under an anchor travels as one row, and
equal runs are counted as one, by a cryptographic digest of their words. Runs of an anchor that has several of them
are exploded to single windows, which Spark counts by (half of the anchor, window hash), 96 bits together.
Windows that occur once are kept; all other windows under repeated anchors are removed, merged to maximal
intervals of words.

Nulls and ties: a null or blank text has no words and the digest of the empty string; texts below 35 words
lose nothing; a null doc_id is a document like any other. Windows are judged on the input, so all copies of
a repeated window go, the first one too, and of repeated rows all do. Empty tables give no rows. Other
columns of the input are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm import anchored as A
from capquill.llm import kernels as K
from capquill.llm.common import table

WIDTH, GRAM = 35, 8


def _units(data: np.ndarray, off: np.ndarray):
    w = K.words(data, off)
    return w.hash, w.first, w.hash, w


def _digests(runs: A.Runs, removed: np.ndarray) -> list[str]:
    """SHA-256 of each document's kept words, joined by a space."""
    data, off, w, keep = runs.data, runs.off, runs.more, ~removed
    start, end, document = w.start[keep], w.end[keep], w.document()[keep]
    mask = A.covered(len(data), start, end)
    blank = start[1:][document[1:] == document[:-1]] - 1  # a separator always stands there
    out = data.copy()
    out[blank] = 32
    mask[blank] = True
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=ends[1:])
    packed, at = memoryview(out[mask]), ends[off]
    return [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _windows(chunk: A.Chunk, documents: np.ndarray, runs: A.Runs, at: np.ndarray, wanted: pa.Table, width: int) -> pa.Table:
    """The hash of each window of the runs that were asked for; its place only if its run occurs once."""
    low, high = runs.low[at], runs.high[at] + 1
    starts, size = A.spread(low, high), high - low
    times = wanted["times"].to_numpy()
    alone = times == 1
    own = starts - np.repeat(runs.first[runs.document[at]], size)
    return pa.table({
        "seed": np.repeat((runs.seed[at] >> np.uint64(16)).astype(np.int64).astype(np.int32), size), "window": K.window_hashes(runs.raw, width)[starts].view(np.int64),
        "times": np.repeat(np.minimum(times, 2), size), "at": np.repeat(np.where(alone, wanted["at"].to_numpy(), -1), size), "low": np.where(np.repeat(alone, size), own, -1),
    })


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (words), n_removed, n_spans, sha (of the kept words) of each document."""
    of, texts = A.Windows(_units, width, GRAM, merged=False), A.dealt(docs)
    marked = A.marks(texts, of, stays=False)
    windows = A.asked(texts, marked, of, lambda *x: _windows(*x, width), "seed int, window bigint, times bigint, at bigint, low bigint")
    counted = windows.groupBy("seed", "window").agg(F.sum("times").alias("times"), F.max("at").alias("at"), F.max("low").alias("low"))
    kept = counted.where("times = 1").select("at", "low", (F.col("low") + 1).alias("high"))
    return A.finish(texts, marked, kept, of, _digests)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.col("sha").alias("kept_sha256"), "n_spans")
