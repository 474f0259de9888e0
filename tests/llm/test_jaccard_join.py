import random
import re
from collections import Counter

import pytest

from capquill.llm import jaccard_join as J
from capquill.llm.components import components
from tests.llm.cases import SCHEMA, SF, awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    ids, sets = [r.doc_id for r in rows], [shingles(r.text, width) for r in rows]
    root, links = list(range(len(ids))), [0] * len(ids)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)), links[i]) for i, d in enumerate(ids))


def near_copies(spark, n=60):
    r, out, base = random.Random(4), [], [prose(k, k, 3000).split(" ") for k in (8, 40, 90, 200)]
    line = "the very same line in all of them here".split(" ")
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randrange(0, max(2, len(words) // 25))):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        out.append((i, " ".join(words + (line if i % 3 == 0 else [])), None, None, None, 1, "h", 1))
    return spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("source,width,percent,kw", [
    (documents, 3, 90, {}), (awkward, 3, 90, {}), (awkward, 5, 80, {"hot_over": 1}),
    (near_copies, 3, 90, {"group": 4, "queries": 3}), (near_copies, 5, 80, {"hot_over": 4}), (near_copies, 3, 60, {"group": 7}),
])
def test_matches_brute_force(spark, source, width, percent, kw):
    df = source(spark)
    want = brute(df.collect(), width, percent)
    got = Counter(map(tuple, J.join(df, width, percent, **kw).select("doc_id", "n_shingles", "component_id", "n_links").collect()))
    assert got == want and any(k[3] for k in got)


def test_keep_one_keeps_one_of_each_component(spark):
    df = awkward(spark)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[4] == 1 and ids[5] == 0 and ids[14] == 1 and ids[0] == ids[1] == 1 and ids[None] == 2
    assert J.join(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 200).selectExpr("id as u", "id - 1 as v").union(spark.createDataFrame([(500, 400), (400, 450)], "u long, v long"))
    rows = components(edges).collect()
    assert {(r.u, r.v) for r in rows} == {(i, 0) for i in range(1, 200)} | {(450, 400), (500, 400)}
