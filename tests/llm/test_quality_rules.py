import re
from collections import Counter

import numpy as np
import pytest

from capquill.llm import quality_rules as Q
from tests.llm.cases import SF, awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    many = Counter(windows)
    hit = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), again, len(hit))


@pytest.mark.parametrize("source", ["awkward", "sample"])
def test_counts_match_brute_force(spark, source):
    df = awkward(spark) if source == "awkward" else documents(spark)
    got = Counter((r[0], *r[1:6]) for r in Q.statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())


def test_learned_list_separates_labels(spark):
    rows = {r.doc_id: r for r in Q.op10_quality_rules(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    hit = np.array([(rows[r.doc_id].kept or rows[r.doc_id].base_failed, r.quality) for r in labels])
    assert (hit[:, 0] == hit[:, 1]).mean() > 0.9


def test_list_is_ordered_and_default_is_good(spark):
    x = np.random.default_rng(1).random((600, len(Q.RATIOS)))
    rules = Q.learn_list(x, x[:, 0] > 0.7)
    assert rules.rules and "symbol_ratio" in str(rules)
    assert Q.learn_list(x, np.zeros(600, bool)).rules == ()
    assert Q.learn_list(x[:0], np.zeros(0, bool)).rules == ()


def test_no_labels_keeps_what_passes_the_base(spark):
    counts = Q.statistics(awkward(spark))
    labels = spark.createDataFrame([(1, None, 0), (None, 0, 0), (10**6, 0, 0)], "doc_id bigint, quality int, toxic int")
    rules = Q.learn(counts, labels)
    assert rules.rules == () and all(r.kept != r.base_failed for r in Q.judge(counts, rules).collect())
    assert Q.judge(Q.statistics(awkward(spark).limit(0)), rules).count() == 0
