import math

import numpy as np
import pytest

from capquill.llm import whitening as W
from tests.llm.cases import SF


def as_integers(vectors):
    return [[math.floor(1024 * float(np.float32(c)) if isinstance(c, float) else 1024 * c) + 100_000 for c in v] for v in vectors]


def brute(vectors, k=8):
    """Rows of (deviation, whitened up to sign), explained and the eigenvalues, by a dense eigendecomposition."""
    x = as_integers(vectors)
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    return deviation, centred @ vectors_[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(rows, ids, vectors, k=8):
    deviation, white, explained = brute(vectors, k)
    assert len(rows) == len(ids) * k and {r.n for r in rows} == {len(ids)}
    got = np.zeros((len(ids), k))
    at = {i: j for j, i in enumerate(ids)}
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    for c in range(k):
        sign = np.sign((got[:, c] * white[:, c]).sum())
        assert np.allclose(got[:, c] * sign, white[:, c], atol=1e-6)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


def test_sample_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = W.op13_embedding_whitening(spark, SF).collect()
    compare(rows, [r.vec_id for r in table], [r.embedding for r in table])


def test_merging_is_lossless(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(3000, 6)) * [1, 5, 20, 3, 100, 7] + np.arange(3000)[:, None]).round().astype(np.int64) + 100_000
    parts = [W.summarized(p) for p in np.array_split(x, 37)]
    whole, tree = W.summarized(x), W.merged([W.merged(parts[:20]), W.merged(parts[20:]), W.summarized(x[:1] * 0 + 5)])
    assert (W.merged(parts).n, W.merged(parts).sums) == (whole.n, whole.sums)
    assert np.allclose(np.linalg.svd(W.merged(parts).rows)[1], np.linalg.svd(whole.rows)[1], rtol=1e-12)
    direct = W.summarized(np.concatenate([x, x[:1] * 0 + 5]))
    assert np.allclose(tree.rows.T @ tree.rows, direct.rows.T @ direct.rows, rtol=1e-10)


def test_tree_of_many_partitions(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(400, 10)).round(3).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(70)
    w = W.fit(df, 10, fan=3)
    x = np.array(as_integers([[np.float64(c) for c in v] for v in vectors]))
    assert w.n == 400 and np.allclose(w.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], rtol=1e-10)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, 0.25]), (2, [1.5, -1.0, 0.75]), (2, [1.5, -1.0, 0.75]), (None, [0.0, 0.0, 3.0]), (5, [2.0, 2.5, -1.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 1.0]), (9, [1.0, inf, 1.0]), (10, []), (11, [1.0]), (12, [1e30, 0.0, 0.0])]
    schema = "vec_id bigint, embedding array<float>, n int, component string, whitened string, item int"
    df = spark.createDataFrame([(i, v, 1, "c", "w", 2) for i, v in good + bad], schema)
    rows = W.whiten(df).collect()
    deviation, white, _ = brute([v for _, v in good], 3)
    assert len(rows) == 15 and {r.n for r in rows} == {5} and rows[0].identity_error < 1e-8
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviation)
    assert sorted(abs(r.whitened) for r in rows if r.component == 3) == pytest.approx(sorted(abs(white[:, 2])), abs=1e-7)
    one = W.whiten(df.where("vec_id = 1"))
    assert one.count() == 0 and one.columns == W.whiten(df).columns
    assert W.whiten(df.limit(0)).count() == W.whiten(df.where("vec_id > 5")).where("vec_id < 6").count() == 0
    ramp = [(i, [float(i), 2.0 * i]) for i in range(50)]  # one component only has variance
    rows = W.whiten(spark.createDataFrame(ramp, "vec_id bigint, embedding array<double>")).collect()
    assert len(rows) == 50 and {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1)


def test_deviation_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [float(i % 7) * 2.0**30, 1.0]) for i in range(2000)], "vec_id bigint, embedding array<double>")
    x = as_integers([[np.float64(i % 7) * 2.0**30, np.float64(1)] for i in range(2000)])
    s = [sum(r[j] for r in x) for j in range(2)]
    want = [sum((2000 * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    got = {r.vec_id: r.deviation for r in W.whiten(df).collect()}
    assert all(got[i] == (w if w < 2**63 else None) for i, w in enumerate(want)) and None in got.values()
