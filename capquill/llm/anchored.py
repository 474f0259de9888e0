"""Windows that can repeat, found by their anchors.

Every window of a text has an anchor (kernels.anchors): equal windows have equal anchors. So a window can
only repeat under an anchor that occurs twice or more, and runs of windows under one anchor can be looked at together.

Texts are dealt once, packed, into chunks of about `CHUNK` bytes by a hash of doc_id, and stay there: each later
step meets a chunk with the few rows that concern it. A chunk sends one row for each anchor and content of a
run, however often it holds it, so an anchor that very many documents hold is aggregated before it travels.
Nothing is lost by this, whatever the data, and nothing is gathered for an anchor or a content.

A place is (at, low): `at` has the chunk in its upper half and the number of the document in the chunk's order in its
lower half, `low` is the first window start of a run. Documents are ordered by doc_id, nulls first, then by a hash of the
text; rows that repeat both can be merged to one document.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capquill.llm import kernels as K
from capquill.llm.common import KEEP, columns_or_null, partitions

#: Bytes of text in a chunk, about; there are so many chunks for each partition at least.
CHUNK, PER_PARTITION = 1 << 20, 4
#: Units whose anchors are looked for together, about, and texts that are packed together.
PIECE, ROWS = 1 << 16, 500
SEED_BITS = np.uint64((1 << 48) - 1)


def unpacked(batches: Iterator[pa.RecordBatch], target: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts) in pieces of about `target` packed bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("packed")).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + target, "right")))
            rows = batch.slice(a, b - a)
            yield rows, pa.array([unpack(t.as_py()) for t in rows.column("packed")], pa.large_binary())
            a = b


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Index into sorted `of` for each value, -1 where it is missing."""
    at = np.minimum(np.searchsorted(of, values), max(len(of) - 1, 0))
    return np.where(of[at] == values, at, -1) if len(of) else np.full(len(values), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for rows in (batch.slice(a, ROWS) for batch in batches for a in range(0, len(batch), ROWS)):
        texts = rows.column("text").cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([squeeze(t.as_py() or b"") for t in texts], pa.binary())], names=["chunk", "doc_id", "rid", "packed"])


def dealt(docs: DataFrame) -> DataFrame:
    """chunk, doc_id, rid (a hash of the text) and packed text of each document, dealt by chunk."""
    docs = columns_or_null(docs, doc_id="bigint", text="string").withColumn("rid", F.xxhash64("text"))
    n = partitions(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", "rid")), F.lit(max(size // CHUNK, PER_PARTITION * n))).alias("chunk")
    packed = docs.select(chunk, "doc_id", "rid", "text").mapInArrow(_pack, "chunk bigint, doc_id bigint, rid bigint, packed binary")
    return packed.repartition(n, "chunk").sortWithinPartitions("chunk").persist(KEEP)


@dataclass(frozen=True)
class Windows:
    """What is looked for: windows of `width` units, with anchors of `gram` units at most."""

    #: units(data, off) returns (values or bytes that stand for K.BYTE_VALUES, first unit of each document, the units as they are, more).
    units: Callable
    width: int
    gram: int
    #: Whether rows that repeat doc_id and text are one document.
    merged: bool


@dataclass
class Runs:
    """Runs of windows of some documents of a chunk."""

    data: np.ndarray
    off: np.ndarray
    first: np.ndarray  # first unit of each document, and one more
    seed: np.ndarray
    low: np.ndarray  # window starts, in units of all documents
    high: np.ndarray
    document: np.ndarray
    raw: np.ndarray  # the units as bytes
    more: object = None

    def content(self, width: int, key: bytes) -> np.ndarray:
        scale = self.raw.itemsize
        return K.text_hashes(self.raw.view(np.uint8), self.low * scale, (self.high + width) * scale, key)

    def own(self) -> np.ndarray:
        """`low` within the document."""
        return self.low - self.first[self.document]


def find_runs(data: np.ndarray, off: np.ndarray, of: Windows) -> Runs:
    """Anchors need some 100 bytes a unit meanwhile, so whole documents are looked at a piece at a time, however many share a chunk."""
    values, first, raw, more = of.units(data, off)
    found, a, n = [], 0, len(first) - 1
    while a < n or not found:
        b = min(n, max(a + 1, int(np.searchsorted(first, first[a] + PIECE, "right")) - 1))
        piece = values[first[a] : first[b]]
        x = K.anchors(K.BYTE_VALUES[piece] if piece.dtype == np.uint8 else piece, first[a : b + 1] - first[a], of.width, min(of.gram, of.width))
        found.append((x.seed & SEED_BITS, x.low + first[a], x.high + first[a]))
        a = b
    seed, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    return Runs(data, off, first, seed, low, high, np.searchsorted(first, low, "right") - 1, np.ascontiguousarray(raw), more)


class Chunk:
    """The documents of a chunk in their order."""

    def __init__(self, rows: pa.Table, merged: bool):
        number, known = rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_valid().to_numpy()
        rid = rows["rid"].to_numpy()
        order = np.lexsort((rid, number, known))
        number, known, rid = number[order], known[order], rid[order]
        twin = (number[1:] == number[:-1]) & (known[1:] == known[:-1])
        new = np.append(True, ~(twin & (rid[1:] == rid[:-1]) & merged))
        shared = ~known
        shared[1:] |= twin
        shared[:-1] |= twin
        self.rows = rows.take(order)
        #: The document of each row, and a row of each document.
        self.document, self.row = np.cumsum(new) - 1, np.flatnonzero(new)
        #: Orders documents of the same doc_id.
        self.twin = np.where(shared, rid, 0)[self.row]
        self.base = rows["chunk"][0].as_py() << 32

    def doc_id(self, documents: np.ndarray) -> pa.ChunkedArray:
        return self.rows["doc_id"].take(self.row[documents])

    def texts(self, documents: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows = self.row if documents is None else self.row[documents]
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(t) for t in self.rows["packed"].take(rows).to_pylist()]
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        return np.frombuffer(b"".join(texts), np.uint8), off


_OCCURRENCE = "seed bigint, content bigint, doc_id bigint, twin bigint, at bigint, low bigint, times bigint, many boolean"


def _occurrences(rows: pa.Table, of: Windows, key: bytes) -> pa.Table:
    """The first run of each anchor and content in a chunk, how often it has that, and whether it has the anchor more than once."""
    chunk = Chunk(rows, of.merged)
    runs = find_runs(*chunk.texts(), of)
    content = runs.content(of.width, key)
    order = np.lexsort((content, runs.seed))
    seed, content = runs.seed[order], content[order]
    new_seed = np.ones(len(order), bool)
    new_seed[1:] = seed[1:] != seed[:-1]
    new = new_seed.copy()
    new[1:] |= content[1:] != content[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    many = np.diff(np.append(np.flatnonzero(new_seed), len(order)))[np.cumsum(new_seed)[at] - 1] > 1
    by = np.argsort(order[at])
    pick = order[at][by]
    document = runs.document[pick]
    return pa.table({
        "seed": seed[at][by].view(np.int64), "content": content[at][by].view(np.int64), "doc_id": chunk.doc_id(document), "twin": chunk.twin[document],
        "at": chunk.base + document, "low": runs.own()[pick], "times": times[by], "many": many[by],
    })


_MARK = "at bigint, low bigint, times bigint, asked boolean, salt bigint"


def _marks(batches: Iterator[pa.RecordBatch], hot: int, stays: bool) -> Iterator[pa.RecordBatch]:
    """From occurrences in the order of (seed, content, document, low): places whose anchor repeats.

    Where an anchor has several contents, the first place of each is `asked` for what it holds, with the times of the
    content in all. Windows of one run differ, so an only content has nothing to be compared with: its first place
    `stays` as a whole (a salt of -1) or goes like the others; it gets no row if that is what finish() takes for granted.
    `salt` counts the contents of an anchor by `hot`. The first place of the last content is carried from batch to batch.
    """
    names = ("seed", "content", "at", "low", "times", "many")
    held: dict[str, np.ndarray] | None = None
    only = -1 if stays else 0
    again, rank = False, 0  # of the held content: whether its anchor has come before it, and how many contents

    def rows(c: dict[str, np.ndarray], asked: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c["at"]), pa.array(c["low"]), pa.array(c["times"]), pa.array(asked), pa.array(salt)], names=["at", "low", "times", "asked", "salt"])

    for batch in batches:
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        if not len(batch):
            continue
        if held is not None:
            c = {k: np.concatenate((held[k], v)) for k, v in c.items()}
        n = len(c["seed"])
        new_seed = np.ones(n, bool)
        new_seed[1:] = c["seed"][1:] != c["seed"][:-1]
        new = new_seed.copy()
        new[1:] |= c["content"][1:] != c["content"][:-1]
        group, seed = np.cumsum(new) - 1, np.cumsum(new_seed) - 1
        at = np.flatnonzero(new)
        run = seed[at]
        begin = np.flatnonzero(new_seed)
        repeated = (np.diff(np.append(begin, n)) > 1) | np.logical_or.reduceat(c["many"], begin)
        repeated[0] |= again
        ranks = np.arange(len(at)) - group[begin][run]
        ranks[run == 0] += rank
        contents = np.bincount(run)
        contents[0] += rank
        other = repeated[seed] & ~new & ~c["many"]
        if other.any():
            yield rows({k: v[other] for k, v in c.items()}, np.zeros(other.sum(), bool), np.zeros(other.sum(), np.int64))
        total = np.add.reduceat(c["times"], at)
        firsts = {k: v[at] for k, v in c.items()} | {"times": total}
        asked = contents[run] > 1
        out = repeated[run] & (asked | (firsts["many"] == stays))
        out[-1] = False
        if out.any():
            yield rows({k: v[out] for k, v in firsts.items()}, asked[out], np.where(asked, ranks // hot, only)[out])
        held = {k: v[-1:] for k, v in firsts.items()}
        again, rank = bool(repeated[-1]), int(ranks[-1])
    if held is not None and again:
        asked = np.array([rank > 0])
        if asked[0] or held["many"][0] == stays:
            yield rows(held, asked, np.array([rank // hot if asked[0] else only]))


def marks(texts: DataFrame, of: Windows, *, hot: int = 1 << 62, stays: bool) -> DataFrame:
    key = os.urandom(16)  # whoever writes a text can't know it, so not make contents that collide
    found = texts.groupBy("chunk").applyInArrow(lambda t: _occurrences(t, of, key), _OCCURRENCE)
    order = ["seed", "content", F.asc_nulls_first("doc_id"), "twin", "low"]
    return found.repartition("seed").sortWithinPartitions(*order).mapInArrow(lambda it: _marks(it, hot, stays), _MARK).persist(KEEP)


def _at_chunks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.shiftright("at", 32)).groupBy("chunk")


def asked(texts: DataFrame, marked: DataFrame, of: Windows, give: Callable, schema: str) -> DataFrame:
    """What give(chunk, documents, runs, kept runs, their marks) makes of the places that were asked for."""

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return empty
        chunk = Chunk(rows, of.merged)
        number = wanted["at"].to_numpy() & 0xFFFFFFFF
        documents = np.unique(number)
        runs = find_runs(*chunk.texts(documents), of)
        order = np.lexsort((wanted["low"].to_numpy(), number))
        start = wanted["low"].to_numpy()[order] + runs.first[np.searchsorted(documents, number[order])]
        return give(chunk, documents, runs, np.searchsorted(runs.low, start), wanted.take(order))

    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    empty = pa.table({c: pa.array([], kinds[k]) for c, k in (x.split(" ") for x in schema.split(", "))})
    return texts.groupBy("chunk").cogroup(_at_chunks(marked.where("asked").drop("asked"))).applyInArrow(run, schema)


def finish(texts: DataFrame, marked: DataFrame, kept: DataFrame, of: Windows, digest: Callable) -> DataFrame:
    """One row per row of the input: doc_id, n, n_removed, n_spans, sha.

    kept: at, low, high of window starts that stay though their anchor repeats, as do whole runs that are marked so; digest(runs, flags of the units that
    go) returns the digest of what is left of each document.
    """

    def run(rows: pa.Table, info: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), **{c: pa.array([], pa.int64()) for c in ("n", "n_removed", "n_spans")}, "sha": pa.array([], pa.string())})
        chunk = Chunk(rows, of.merged)
        runs = find_runs(*chunk.texts(), of)
        values, count = np.unique(runs.seed, return_counts=True)
        goes = count[np.searchsorted(values, runs.seed)] > 1
        low = info["low"].to_numpy() + runs.first[info["at"].to_numpy() & 0xFFFFFFFF]
        high = info["high"].fill_null(-1).to_numpy().copy()
        goes[np.searchsorted(runs.low, low[high < 0])] = True
        n = int(runs.first[-1])
        gone = covered(n, runs.low[goes], runs.high[goes] + 1)
        whole = high == 0
        high[whole] = (runs.high - runs.low + 1)[np.searchsorted(runs.low, low[whole])]
        stay = high > 0
        gone[spread(low[stay], low[stay] + high[stay])] = False
        at = np.flatnonzero(gone)
        removed = covered(n, at, at + of.width)
        row = chunk.document
        return pa.table({
            "doc_id": chunk.rows["doc_id"], "n": np.diff(runs.first)[row], "n_removed": sums(removed, runs.first)[row],
            "n_spans": spans(removed, runs.first)[row], "sha": pa.array(digest(runs, removed), pa.string()).take(row),
        })

    places = marked.select("at", "low", F.when(F.col("salt") < 0, 0).cast("bigint").alias("high"))
    info = places.unionByName(kept.select("at", "low", (F.col("high") - F.col("low")).alias("high")))
    return texts.groupBy("chunk").cogroup(_at_chunks(info)).applyInArrow(run, "doc_id bigint, n bigint, n_removed bigint, n_spans bigint, sha string")


def covered(length: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Flags of the positions within any of the half-open ranges."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.cumsum(edge[:-1]) > 0


def spans(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of maximal runs of set flags in each document."""
    starts = flags.copy()
    starts[1:] &= ~flags[:-1]
    at = first[:-1][first[:-1] < len(flags)]
    starts[at] = flags[at]
    return sums(starts, first)


def sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All positions of the half-open ranges, one range after the other."""
    size = high - low
    return np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(low) else np.empty(0, np.int64)
