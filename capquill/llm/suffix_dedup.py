"""Suffix-array dedup (operator 1): bytes covered by a 100-byte string that also starts earlier.

Candidate windows are those under repeated anchors (anchored.py). Where an anchor has several contents, the text around
each run travels once per distinct content, with its least position (copies of an only content but the first go as they
are); shards of whole anchors are concatenated in the order of
position and sorted by recursive induced sorting (suffix_array.py), and the permuted common prefixes split the suffixes
into classes that share 100 bytes. The first member of each class stays, everything else under repeated
anchors is removed. An anchor with more than `HOT` contents is dealt over several shards; the first members of
its classes then meet once more, in a pre-aggregated minimum by anchor and cryptographic digest of the window.

Nulls and ties: a null text is empty; texts below 100 bytes lose nothing; a null doc_id comes before all
others; rows that repeat both doc_id and text are one document, each with the same result (neither is
earlier); documents that share a doc_id, or have none, are ordered by a hash of their text. Empty tables give no
rows. Other columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm import anchored as A
from capquill.llm import kernels as K
from capquill.llm.common import KEEP, table
from capquill.llm.suffix_array import permuted_common_prefix, suffix_array

WIDTH, GRAM = 100, 28
#: Bytes that are sorted together at least, if there are as many, and contents beyond which an anchor is dealt over shards.
SHARD, HOT = 1 << 20, 2_000
#: Never a byte of UTF-8 text.
FENCE = 0xFF


def _units(data: np.ndarray, off: np.ndarray):
    return data, off, data, None


def _contexts(chunk: A.Chunk, documents: np.ndarray, runs: A.Runs, at: np.ndarray, wanted: pa.Table, width: int) -> pa.Table:
    """The text of the runs that were asked for."""
    low, high = runs.low[at], runs.high[at] + width
    first = np.concatenate(([0], np.cumsum(high - low))).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(first), pa.py_buffer(runs.data[A.spread(low, high)])])
    of = documents[runs.document[at]]
    return pa.table({
        "seed": runs.seed[at].view(np.int64), "salt": wanted["salt"], "doc_id": chunk.doc_id(of), "twin": chunk.twin[of], "at": wanted["at"], "low": wanted["low"], "bytes": pieces,
    })


_CONTEXT = "seed bigint, salt bigint, doc_id bigint, twin bigint, at bigint, low bigint, bytes binary"
_FIRST = "seed bigint, window binary, doc_id bigint, twin bigint, at bigint, low bigint, high bigint"


def _firsts(rows: pa.RecordBatch, width: int, hot: int) -> pa.RecordBatch:
    """The first member of each class of equal windows among the contexts of some anchors."""
    seed, salt = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "salt"))
    new = np.append(True, (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1]))
    members = np.diff(np.append(np.flatnonzero(new), len(seed)))[np.cumsum(new) - 1]
    whole_anchor = (salt == 0) & (members < hot)  # the first salt is full before there is a second one
    doc = rows.column("doc_id")
    number, known = doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False)
    low = rows.column("low").to_numpy(zero_copy_only=False)
    order = np.lexsort((low, rows.column("twin").to_numpy(zero_copy_only=False), number, known))
    rows, low, whole_anchor = rows.take(pa.array(order)), low[order], whole_anchor[order]
    data, off = K.text_buffers(rows.column("bytes"))
    size = np.diff(off)
    begin = off[:-1] + np.arange(len(size))  # one fence after each context
    t = np.full(len(data) + len(size), FENCE, np.uint8)
    t[A.spread(begin, begin + size)] = data
    sa = suffix_array(t)
    plcp = permuted_common_prefix(t, sa, int(size.max()) + 8, begin)
    whole = np.zeros(len(t), bool)
    whole[A.spread(begin, begin + size - width + 1)] = True
    sa = sa[whole[sa]]
    new = plcp[sa] < width
    if len(new):
        new[0] = True
    first = np.sort(np.minimum.reduceat(sa, np.flatnonzero(new))) if len(sa) else sa
    context = np.searchsorted(begin, first, "right") - 1
    alone = whole_anchor[context]
    # anchors in one shard: ranges of window starts; others: single windows
    joins = np.zeros(len(first), bool)
    joins[1:] = (first[1:] == first[:-1] + 1) & (context[1:] == context[:-1]) & alone[1:]
    at = np.flatnonzero(~joins)
    last = np.append(at[1:], len(first)) - 1
    context, alone, start, stop = context[at], alone[at], first[at], first[last] + 1
    digests = [None if a else hashlib.blake2b(t[s : s + width], digest_size=16).digest() for a, s in zip(alone.tolist(), start.tolist(), strict=True)]
    of = pa.array(context)
    shift = low[context] - begin[context]
    return pa.RecordBatch.from_arrays(
        [rows.column("seed").take(of), pa.array(digests, pa.binary()), *(rows.column(c).take(of) for c in ("doc_id", "twin", "at")), pa.array(start + shift), pa.array(stop + shift)],
        names=["seed", "window", "doc_id", "twin", "at", "low", "high"],
    )


def _sort_shards(batches: Iterator[pa.RecordBatch], width: int, shard: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Contexts come ordered by (seed, salt); each shard takes whole (seed, salt) groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < shard:
            continue
        rows = pa.concat_batches(held)
        seed, salt = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "salt"))
        changes = np.flatnonzero((seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1])) + 1
        begin = 0
        per_row = max(1, rows.nbytes // len(rows))
        for cut in changes:
            if (cut - begin) * per_row >= shard or cut == changes[-1]:
                yield _firsts(rows.slice(begin, cut - begin), width, hot)
                begin = int(cut)
        held = [rows.slice(begin)]
    if held and (rows := pa.concat_batches(held)).num_rows:
        yield _firsts(rows, width, hot)


def remove_repeats(docs: DataFrame, width: int = WIDTH, *, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n (bytes), n_removed, n_spans, sha (of the remaining bytes) of each document."""
    of, texts = A.Windows(_units, width, GRAM, merged=True), A.dealt(docs)
    marked = A.marks(texts, of, hot=hot, stays=True)
    contexts = A.asked(texts, marked, of, lambda *x: _contexts(*x, width), _CONTEXT)
    dealt = contexts.repartition("seed", "salt").sortWithinPartitions("seed", "salt")
    firsts = dealt.mapInArrow(lambda it: _sort_shards(it, width, shard, hot), _FIRST).persist(KEEP)
    among = firsts.where("window is not null").groupBy("seed", "window").agg(F.min(F.struct("doc_id", "twin", "low", "at", "high")).alias("one"))
    kept = firsts.where("window is null").select("at", "low", "high").unionByName(among.select("one.at", "one.low", "one.high"))
    return A.finish(texts, marked, kept, of, _digests)


def _digests(runs: A.Runs, removed: np.ndarray) -> list[str]:
    left = np.zeros(len(removed) + 1, np.int64)
    np.cumsum(~removed, out=left[1:])
    whole, at = memoryview(runs.data[~removed]), left[runs.off].tolist()
    return [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))
