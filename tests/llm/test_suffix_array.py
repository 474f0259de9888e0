import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capquill.llm import suffix_array as module
from capquill.llm.suffix_array import permuted_common_prefix, suffix_array


def check(t):
    b = t.tolist()
    sa = suffix_array(t)
    assert sorted(sa.tolist()) == list(range(len(t)))
    keys = [b[i:] for i in sa]
    assert keys == sorted(keys)
    if t.dtype != np.uint8:
        return
    plcp = permuted_common_prefix(t, sa, 10**6, np.array([0] if len(t) else [], int))
    for r, i in enumerate(sa):
        x, y = b[i:], b[sa[r - 1] :] if r else []
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert plcp[i] == (n if r else 0)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=80).map(str.encode) | st.text("abc", max_size=80).map(lambda s: (s * 3).encode()))
def test_small_texts(b):
    check(np.frombuffer(b, np.uint8))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 900), max_size=60) | st.lists(st.integers(0, 2), max_size=40).map(lambda x: x * 3), st.sampled_from([2, 5, 12_000]))
def test_texts_of_names(values, part):
    held, module.PART = module.PART, part
    try:
        check(np.array(values, np.int64))
    finally:
        module.PART = held


@pytest.mark.parametrize("seed", [10, 100, 4000])
def test_larger_texts(seed):
    r = np.random.default_rng(seed)
    words = r.integers(97, 123, (300, 5)).astype(np.uint8)
    t = words[r.integers(0, 300, 600)].reshape(-1)
    t = np.concatenate((t, t[500:1500], np.full(300, 97, np.uint8), t[200:900], [255], t[:50])).astype(np.uint8)
    check(t)
    levels = []
    suffix_array(t, levels)
    assert len(levels) > 3 and all(2 * b <= a for a, b in zip(levels, levels[1:]))  # names of names, each text at most half as long
