"""Texts whose patterns make polynomials modulo a power of two collide."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from capquill.llm import jaccard_join, kernels, quality_rules, substring_dedup
from tests.llm.test_dedup import COLUMNS, Counter, brute_words
from tests.llm.test_jaccard_join import brute


def pattern(n=1024):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_words_that_repeat_nowhere_stay(spark):
    x, y = pattern()
    common = " ".join(f"w{i}" for i in range(60))
    df = frame(spark, [f"{common} {x} {common}", f"{common} {y} other words here", " ".join(pattern(128)[0]), " ".join(pattern(128)[1])])
    got = substring_dedup.remove_repeats(df).select(COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute_words(df.collect(), 35)


def test_different_texts_are_not_linked(spark):
    x, y = pattern()
    df = frame(spark, [x, y, f"one two {x}", f"one two {y}", f"one two {x}"])
    got = jaccard_join.join(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert Counter(map(tuple, got)) == brute(df.collect(), 3, 90)


def test_different_lines_are_not_repeats(spark):
    x, y = pattern()
    rows = {r.doc_id: r for r in quality_rules.statistics(frame(spark, [f"{x}\n{y}", f"{x}\n{y}\n{x}"])).collect()}
    assert rows[0].n_dup_lines == 0 and rows[1].n_dup_lines == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=90), max_size=20))
def test_word_hashes_follow_the_words(words):
    data = " ".join(words).encode()
    w = kernels.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(set(zip(words, w.hash.tolist()))) == len(set(words)) == len(set(w.hash.tolist()))
