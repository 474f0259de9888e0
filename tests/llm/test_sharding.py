import random
import zlib
from collections import Counter, defaultdict

from capquill.llm import sharding as S
from tests.llm.cases import SF, awkward, documents


def sums(parts, moves, k):
    out = [0] * k
    for p, m in zip(parts, moves):
        for w, s in zip(p, m):
            out[s] += w
    return out


def test_differencing_is_a_partition_and_tight():
    r = random.Random(5)
    parts = [[r.randrange(1, 10**6)] for _ in range(500)]
    moves = S.differencing(parts, 7)
    assert all(sorted(m) == list(range(7)) for m in moves)
    got = sums(parts, moves, 7)
    assert sum(got) == sum(p[0] for p in parts) and max(got) - min(got) < 100
    assert S.differencing([[4], [5], [6], [7], [8]], 2) and sorted(sums([[4], [5], [6], [7], [8]], S.differencing([[4], [5], [6], [7], [8]], 2), 2)) == [14, 16]
    assert S.differencing([], 3) == []


def check(rows, texts, k):
    shard_of, slots, total = {}, defaultdict(list), Counter()
    for r in rows:
        text = texts[r.doc_id] if r.doc_id in texts else None
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        if r.doc_id in texts:
            assert r.size == len((text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text or "").encode())
            assert shard_of.setdefault((text is None, text), r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(k))
    return total


def test_sample_table(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = S.op8_sharding(spark, SF).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    total = check(rows, texts, 24)
    assert max(total.values()) <= 1.05 * sum(total.values()) / 24 + 20000


def test_tree_of_blocks(spark):
    groups = spark.range(3000).selectExpr("cast(cast(id as string) as binary) as group", "1 + pmod(xxhash64(id), 5000) as weight")
    rows = S.group_shards(groups, 6, block=100, fan=4).join(groups, "group").collect()
    assert len(rows) == 3000
    total = Counter()
    for r in rows:
        total[r.shard] += r.weight
    assert max(total.values()) - min(total.values()) < 200


def test_awkward_rows(spark):
    df = awkward(spark)
    texts = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    rows = S.assign(df, 5).collect()
    assert len(rows) == df.count()
    check(rows, texts, 5)
    assert S.assign(df.limit(0), 5).count() == 0
