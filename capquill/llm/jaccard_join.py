"""N-gram Jaccard join (operator 5) by a token-group matrix.

Documents with equal shingle sets form one class, found by a pre-aggregated digest of the set; one text of each
class travels, once, and stays where its class is dealt. Classes that share a token of their prefixes are
partitioned into groups of similar ones. The matrix has a row for each prefix token and group; joined with
the prefixes of the classes it gives, with the bounds on the sizes, the groups that a query may have a partner in.
Each such group's token union is stored as a bitmap of hashed tokens: a bit of the query that the union lacks is a
token that no member has, so it bounds the query's overlap with the group. Only groups that this bound lets
pass are opened: there the bitmaps of the single members bound each pair in the same way. What is left is looked at
with its texts, and each pair is compared exactly. Every pair of linked classes is found once; components
follow from the links.

Prefixes: of n tokens the first n - ceil(t * n) + m in a fixed order, with m = 1 + n // 30. Two sets of
similarity t share at least the lesser m of their prefix tokens, so that is what a query must share with the
prefix tokens of a group; passages that many documents hold do not reach it. The order is by hash, with
tokens that are frequent in prefixes moved to the end. Frequency is counted over all classes in `BUCKETS` buckets of
tokens, a bounded table. Shingles are 64-bit hashes. Any such order gives the same, whole result.

Nulls and ties: a null or blank text has no shingles and is linked with nothing; a null doc_id is linked
like any other, but never names a component that has another member; rows that repeat a text are one class. Empty
tables give no rows; rows that repeat a doc_id with another text are documents of their own. Other columns are
dropped by the join and passed on by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capquill.llm import anchored as A
from capquill.llm import kernels as K
from capquill.llm.common import KEEP, columns_or_null, cut, partitions, table
from capquill.llm.components import components

#: Members of a group, their tokens, and queries that open it in one task, on average at most.
GROUP, TOKENS, QUERIES = 512, 1 << 20, 1_024
#: Token buckets that are counted. Tokens of a bucket are moved to the end of the order if more prefixes than HOT, and more than 4 times the mean, have one of them.
BUCKETS, HOT = 1 << 22, 100
#: A prefix has one more token for so many of the set.
MORE = 30
#: Buckets that are summed together.
_SEGMENT = 1 << 14


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk."""
    w = K.words(K.ascii_lower(data), off)
    h = K.window_hashes(w.hash, width)
    prefix = K.prefix_sums(w.hash)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        else:
            out.append(K.span_hashes(prefix, np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + n // MORE) if n else 0


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(BUCKETS - 1)).astype(np.int64)


def _prefix(tokens: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    p = prefix_length(len(tokens), percent)
    last = hot[_bucket(tokens)]
    if last.any():
        tokens = np.concatenate((tokens[~last], tokens[last]))
    return tokens[:p]


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each hashed token, in 4 to 8 times as many bits as there are tokens."""
    bits = np.zeros(max(64, 1 << (4 * len(tokens) - 1).bit_length()), bool)
    bits[(tokens >> np.uint64(24)).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _survey(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for a, data, off in K.chunks(batch.column("text")):
            sets, whole = shingle_sets(data, off, width), memoryview(np.ascontiguousarray(data))
            rows = batch.slice(a, len(sets))
            packed = [squeeze(whole[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(map(set_key, sets), pa.binary()), pa.array(packed, pa.binary()), rows.column("rest")],
                names=["doc_id", "n", "class", "packed", "rest"],
            )


def _first_of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their class, the first of each."""
    last = None
    for batch in batches:
        keys = batch.column("class").to_pylist()
        keep = [k != before for k, before in zip(keys, [last, *keys[:-1]], strict=True)]
        last = keys[-1] if keys else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _sets(rows: pa.Table | pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, tokens) of each row with a packed text."""
    at = 0
    for batch in [rows] if isinstance(rows, pa.RecordBatch) else rows.combine_chunks().to_batches():
        for part, texts in A.unpacked([batch]):
            for a, data, off in K.chunks(texts):
                for i, tokens in enumerate(shingle_sets(data, off, width), at + a):
                    yield i, tokens
            at += len(part)


def _tally(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Prefix tokens of each bucket, a row for each segment of buckets that has any."""
    counts, none = np.zeros(BUCKETS, np.uint32), np.zeros(BUCKETS, bool)
    for batch in batches:
        for _, tokens in _sets(batch, width):
            np.add.at(counts, _bucket(_prefix(tokens, percent, none)), 1)
    yield _segments(counts)


def _segments(counts: np.ndarray) -> pa.RecordBatch:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = counts.reshape(-1, _SEGMENT)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([squeeze(parts[i].tobytes()) for i in some], pa.binary())], names=["segment", "counts"])


def _add_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each segment, of rows in the order of the segments."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, total = None, np.zeros(_SEGMENT, np.uint64)

    def summed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["segment", "counts"])

    for batch in batches:
        for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if segment != now:
                if now is not None:
                    yield summed()
                now, total = segment, np.zeros(_SEGMENT, np.uint64)
            total += np.frombuffer(unpack(counts), np.uint32)
    if now is not None:
        yield summed()


def _hot(texts: DataFrame, width: int, percent: int, over: int) -> np.ndarray:
    """Flags of the buckets of tokens that are frequent in the prefixes by hash order."""
    kind = "segment bigint, counts binary"
    tallies = texts.select("packed").mapInArrow(lambda it: _tally(it, width, percent), kind)
    summed = tallies.repartition("segment").sortWithinPartitions("segment").mapInArrow(_add_tallies, kind)
    counts = np.zeros((BUCKETS // _SEGMENT, _SEGMENT), np.uint64)
    for r in summed.collect():  # BUCKETS numbers at most
        counts[r["segment"]] = np.frombuffer(zstandard.decompress(r["counts"]), np.uint64)
    return counts.reshape(-1) > max(over, 4 * int(counts.sum()) // BUCKETS)


def _sketches(batches: Iterator[pa.RecordBatch], width: int, percent: int, hot: bytes) -> Iterator[pa.RecordBatch]:
    flags = np.unpackbits(np.frombuffer(hot, np.uint8)).astype(bool)
    for batch in batches:
        sets = [tokens for _, tokens in _sets(batch, width)]
        prefixes = [_prefix(s, percent, flags) for s in sets]
        first = np.cumsum([0, *map(len, prefixes)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(map(len, sets), pa.int64()), K.list_array(np.concatenate(prefixes).view(np.int64), first, pa.int64()), pa.array(map(bitmap, sets), pa.binary())],
            names=["id", "n", "prefix", "bits"],
        )


def _folded(bits: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps of `words` or twice as many words, all brought to `words`."""
    return np.array([b if len(b) == words else b[:words] | b[words:] for b in bits], np.uint64).reshape(-1, words)


def _bound(rows: pa.Table, percent: int) -> pa.Table:
    """Of the members of a group and its queries, those that the bitmaps allow to have a partner."""
    mine = rows["mine"].to_numpy()
    n, bits = rows["n"].to_numpy(), [np.frombuffer(b, np.uint64) for b in rows["bits"].to_pylist()]
    lacks = n * (100 - percent) // 100  # tokens of a set that a linked one may lack
    inside = rows["part"][0].as_py() == 0
    member, query = np.flatnonzero(mine), np.flatnonzero(~mine)
    size, keep = np.array([len(b) for b in bits]), np.zeros(len(bits), bool)
    for words in np.unique(size):
        m, q = (at[(size[at] == words) | (size[at] == 2 * words)] for at in (member, np.arange(len(bits)) if inside else query))
        if not len(m) or not len(q):
            continue
        have = _folded([bits[i] for i in m], words)
        ask = have if inside and len(q) == len(m) else _folded([bits[i] for i in q], words)
        union = np.bitwise_or.reduce(have)
        opens = np.bitwise_count(ask & ~union).sum(axis=1, dtype=np.int64) <= lacks[q]
        for k in np.flatnonzero(opens):
            i = q[k]
            fits = (m != i) & (np.minimum(size[m], size[i]) == words) & (100 * n[m] >= percent * n[i]) & (100 * n[i] >= percent * n[m])
            at = np.flatnonzero(fits)
            at = at[np.bitwise_count(ask[k] & ~have[at]).sum(axis=1, dtype=np.int64) <= lacks[i]]
            at = at[np.bitwise_count(have[at] & ~ask[k]).sum(axis=1, dtype=np.int64) <= lacks[m[at]]]
            if len(at):
                keep[i] = True
                keep[m[at]] = True
    return rows.filter(pa.array(keep)).select(["group", "part", "id", "mine"])


def _open(rows: pa.Table, percent: int, width: int) -> pa.Table:
    """(id, root, links) of each linked class of a group and its queries: a class of the same component here, and linked documents."""
    rows = rows.take(np.argsort(~rows["mine"].to_numpy(), kind="stable"))
    ids, copies, m = rows["id"].to_pylist(), rows["copies"].to_numpy(), int(rows["mine"].to_numpy().sum())
    sets = [tokens for _, tokens in _sets(rows, width)]
    inside = rows["part"][0].as_py() == 0
    size = np.array([len(s) for s in sets], np.int64)
    links, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if m:
        tokens = np.concatenate(sets[:m])
        owner = np.repeat(np.arange(m), size[:m])
        order = np.argsort(tokens, kind="stable")
        owner = owner[order]
        union, first = np.unique(tokens[order], return_index=True)
        first = np.append(first, len(tokens))
        for q in range(0 if inside else m, len(ids)):
            at = A.member(sets[q], union)
            at = at[at >= 0]
            shared = np.bincount(owner[A.spread(first[at], first[at + 1])], minlength=m)
            partner = np.flatnonzero(100 * shared >= percent * (size[:m] + size[q] - shared))
            if q < m:
                partner = partner[partner > q]
            if len(partner):
                links[q] += copies[partner].sum()
                links[partner] += copies[q]
                for i in {find(int(i)) for i in partner}:
                    root[i] = find(q)
    root = [find(i) for i in range(len(ids))]
    at = np.flatnonzero(links)
    return pa.table({"id": pa.array([ids[i] for i in at], pa.int64()), "root": pa.array([ids[root[i]] for i in at], pa.int64()), "links": pa.array(links[at], pa.int64())})


def _turned(c: str):
    """Another form of a key: joined by it both sides are dealt for the join, and a hot key can be split."""
    return F.bitwise_not(c)


def _linked(docs: DataFrame, rest: T.StructType, width: int, percent: int, group: int, queries: int, hot_over: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, n, class of each of `docs` (doc_id, text, rest); one packed text and rest of each class, of its least doc_id; class, first (rep and id of the component's least) and n_links."""
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("packed", T.BinaryType()), T.StructField("rest", rest)])
    surveyed = docs.mapInArrow(lambda it: _survey(it, width), kind).persist(KEEP)
    mapping = cut(surveyed.select("doc_id", "n", "class"))
    local = surveyed.where("n > 0").sortWithinPartitions("class", F.asc_nulls_last("doc_id")).mapInArrow(_first_of_class, kind)
    one = F.min_by(F.struct("doc_id", "n", "packed", "rest"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("one")
    texts = local.repartition(partitions(docs), "class").groupBy("class").agg(one).select("class", "one.*").sortWithinPartitions("class")
    texts = texts.withColumn("id", F.monotonically_increasing_id()).persist(KEEP)  # the same again if a partition is lost: its rows are ordered
    copies = mapping.where("n > 0").groupBy("class").agg(F.count("*").alias("copies"))
    classes = cut(texts.select("class", "id", F.col("doc_id").alias("rep")).join(copies, "class"))
    surveyed.unpersist()

    hot = np.packbits(_hot(texts, width, percent, hot_over)).tobytes()
    sketches = texts.select("id", "packed").mapInArrow(lambda it: _sketches(it, width, percent, hot), "id bigint, n bigint, prefix array<bigint>, bits binary").persist(KEEP)
    postings = sketches.select(F.explode("prefix").alias("token"), "id", "n")
    shared = postings.groupBy("token").agg(F.count("*").alias("times"), F.min("id").alias("leader")).where("times > 1")
    shared = shared.select(_turned("token").alias("key"), "leader")
    postings = postings.join(shared, _turned("token") == F.col("key")).drop("key").persist(KEEP)
    led = postings.groupBy("id").agg(F.min("leader").alias("leader"), F.first("n").alias("n"))
    large = led.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / group, F.sum("n") / TOKENS)).alias("blocks")).where("blocks > 1")
    large = large.select(_turned("leader").alias("key"), "blocks")
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))
    # small tables are cut from their lineage, so that the plans of what follows stay short
    grouped = cut(led.join(large, _turned("leader") == F.col("key"), "left").select("id", F.xxhash64("leader", block).alias("group")))

    rows = postings.join(grouped, "id").select("token", "id", "n", "group").persist(KEEP)
    matrix = rows.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most")).select(_turned("token").alias("key"), F.col("group").alias("to"), "least", "most")
    fits = (F.col("n") * percent <= 100 * F.col("most")) & (F.col("least") * percent <= 100 * F.col("n"))
    overlap = rows.join(matrix, _turned("token") == F.col("key")).where((F.col("group") < F.col("to")) & fits)
    overlap = overlap.groupBy("id", "n", F.col("to").alias("group")).agg(F.count("*").alias("shared"), F.min("least").alias("least"))
    pairs = cut(overlap.where(F.col("shared") > F.floor(F.least("n", "least") / MORE)).select("id", "group"))
    rows.unpersist()
    postings.unpersist()

    # groups of one that nobody asks for have no link to find
    parts = pairs.groupBy("group").agg(F.ceil(F.count("*") / queries).alias("parts"))
    opens = grouped.groupBy("group").count().where("count > 1").select("group").unionByName(pairs.select("group")).distinct().join(parts, "group", "left")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1))
    members = grouped.join(opens, "group").select("id", "group", every.alias("part"), F.lit(True).alias("mine"))
    asking = pairs.join(parts, "group").select("id", "group", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(False).alias("mine"))
    bounded = members.unionByName(asking).join(sketches.select("id", "n", "bits"), "id")
    bounded = bounded.groupBy("group", "part").applyInArrow(lambda t: _bound(t, percent), "group bigint, part int, id bigint, mine boolean")
    bounded = cut(bounded.join(classes.select("id", "class", "copies"), "id"))
    sketches.unpersist()
    wanted = texts.select("class", "packed").join(bounded, "class").select("group", "part", "id", "mine", "copies", "packed")
    opened = cut(wanted.groupBy("group", "part").applyInArrow(lambda t: _open(t, percent, width), "id bigint, root bigint, links bigint"))

    stars = components(opened.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = opened.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(stars.select(F.col("u").alias("id"), "v"), "id", "left").withColumn("v", F.coalesce("v", "id"))
    first = named.where("rep is not null").groupBy("v").agg(F.min(F.struct("rep", "id")).alias("first")).select(_turned("v").alias("key"), "first")
    named = named.join(first, _turned("v") == F.col("key"), "left").join(links, "id", "left")
    return mapping, texts, named.select("class", "id", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def join(docs: DataFrame, width: int = 3, percent: int = 90, *, group: int = GROUP, queries: int = QUERIES, hot_over: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (linked documents, copies included) of each document."""
    docs = columns_or_null(docs, doc_id="bigint", text="string").withColumn("rest", F.struct(F.lit(0).alias("none")))
    mapping, texts, named = _linked(docs, docs.schema["rest"].dataType, width, percent, group, queries, hot_over)
    named = cut(named.select("class", F.col("first.rep").alias("component_id"), "n_links"))
    texts.unpersist()
    out = mapping.join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in A.unpacked(batches):
        yield pa.RecordBatch.from_arrays([rows.column("rest"), texts.cast(pa.string())], names=["rest", "text"])


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the least doc_id, and all rows without a doc_id or without a word. Of rows that repeat doc_id and shingles one stays."""
    others = [c for c in docs.columns if c != "text"]
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    alone = F.col("doc_id").isNull() | F.coalesce(~F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    _, texts, named = _linked(held.where(~alone), held.schema["rest"].dataType, width, percent, GROUP, QUERIES, HOT)
    kept = cut(named.where("id = first.id").select("class"))
    out = texts.join(kept, "class", "left_semi").select("rest", "packed").mapInArrow(_unpack, T.StructType([held.schema["rest"], T.StructField("text", T.StringType())]))
    out = out.select(*[F.col("text").cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    return out.unionByName(docs.where(alone))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
