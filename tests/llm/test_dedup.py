import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from capquill.llm import anchored, kernels, substring_dedup, suffix_dedup
from tests.llm.cases import SF, awkward, documents, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def spans(flags):
    return sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))


def brute_bytes(rows, width):
    data = [(r.doc_id, (r.text or "").encode()) for r in rows]
    best = {}
    for i, t in data:
        for p in range(len(t) - width + 1):
            s, at = hashlib.md5(t[p : p + width]).digest(), (i is not None, i or 0, p)
            best[s] = min(best.get(s, at), at)
    out = []
    for i, t in data:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if best[hashlib.md5(t[p : p + width]).digest()] < (i is not None, i or 0, p):
                gone[p : p + width] = [True] * width
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans(gone), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def brute_words(rows, width):
    data = [(r.doc_id, WORD.findall((r.text or "").encode())) for r in rows]
    many = Counter(tuple(w[p : p + width]) for _, w in data for p in range(len(w) - width + 1))
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if many[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), spans(gone), hashlib.sha256(left).hexdigest()))
    return Counter(out)


COLUMNS = ["doc_id", "n", "n_removed", "n_spans", "sha"]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
@pytest.mark.parametrize("source,width", [(awkward, 100), (awkward, 40), (documents, 100)])
def test_bytes_match_brute_force(spark, source, width, hot):
    df = source(spark)
    got = suffix_dedup.remove_repeats(df, width, hot=hot, shard=50_000).select(COLUMNS).collect()
    want = brute_bytes(df.collect(), width)
    assert Counter(map(tuple, got)) == want and sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("source,width", [(awkward, 35), (awkward, 5), (documents, 35)])
def test_words_match_brute_force(spark, source, width):
    df = source(spark)
    got = substring_dedup.remove_repeats(df, width).select(COLUMNS).collect()
    want = brute_words(df.collect(), width)
    assert Counter(map(tuple, got)) == want and sum(r.n_removed for r in got) > 0


def test_empty_tables(spark):
    for module in (suffix_dedup, substring_dedup):
        assert module.remove_repeats(awkward(spark).limit(0)).count() == 0


def test_queries(spark):
    assert set(suffix_dedup.op1_suffix_dedup(spark, SF).columns) == {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
    assert {"doc_id", "n_words", "n_removed", "kept_sha256"} <= set(substring_dedup.op2_substring_dedup(spark, SF).columns)


def alike(spark):
    """Copies of a text with nothing but copies of it, within documents and across them, and one text with a copy that differs."""
    a, b, c, d = (prose(150, k) for k in range(40, 44))
    texts = [(9, a), (3, a), (4, a), (None, b), (5, b), (5, b), (6, c + "\n" + d + "\n" + c + "\n" + d + "\n" + c), (7, "z" * 300), (8, "z" * 300)]
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id bigint, text string")


def test_only_contents_are_not_sorted(spark):
    """What has nothing but copies is not sent to be compared, and its first place stays as a whole."""
    copies = spark.createDataFrame([(i, prose(150, 40)) for i in range(6)] + [(7, "z" * 300)], "doc_id bigint, text string")
    of = anchored.Windows(suffix_dedup._units, 100, suffix_dedup.GRAM, merged=True)
    marked = anchored.marks(anchored.dealt(copies), of, stays=True)
    assert marked.where("asked").count() == 0 and marked.count() > 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_copies_within_and_across_documents(spark, hot):
    df = alike(spark)
    got = suffix_dedup.remove_repeats(df, hot=hot, shard=1000).select(COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute_bytes(df.collect(), 100)


def test_runs_take_little_memory_besides_their_chunk():
    """A chunk of many documents is looked at in pieces, with the runs that the whole would have."""
    texts = [prose(3000, k, 5000).encode() for k in range(150)] + [b"", b"z" * 1000, b"y " * 200]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    of = anchored.Windows(suffix_dedup._units, 100, suffix_dedup.GRAM, merged=True)
    anchored.find_runs(data[: off[1]], off[:2], of)  # powers are kept
    tracemalloc.start()
    got = anchored.find_runs(data, off, of)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = kernels.anchors(kernels.BYTE_VALUES[data], off, 100, suffix_dedup.GRAM)
    assert (got.seed == want.seed & anchored.SEED_BITS).all() and (got.low == want.low).all() and (got.high == want.high).all()
    assert peak < 20 * len(data)
