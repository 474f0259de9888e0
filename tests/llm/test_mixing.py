import math

import numpy as np
import pytest

from capquill.llm import mixing as M
from tests.llm.cases import SF, awkward, documents


def test_query_reaches_its_targets(spark):
    rows = M.op4_source_mixing(spark, SF).collect()
    assert len(rows) == documents(spark).count()
    domains = sorted(M.TARGETS)
    total = sum(r.n_tokens for r in rows)
    for d in domains:
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) == pytest.approx(total * M.TARGETS[d], rel=0.03)
    assert all(r.rate >= 0 and math.isclose(sum(r[f"p_{d}"] for d in domains), 1, rel_tol=1e-9) for r in rows)


def test_posteriors_follow_the_labels(spark):
    mixed = {r.doc_id: r for r in M.op4_source_mixing(spark, SF).collect()}
    labels = {r.doc_id: r.domain for r in M.domains_of(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    mean = lambda d, of: np.mean([mixed[i][f"p_{d}"] for i, x in labels.items() if x == of])
    assert mean("poor", "poor") > mean("poor", "good") and mean("toxic", "toxic") > mean("toxic", "good")


def brute(n, p, aim, low, steps):
    x = y = np.ones(len(n))
    t, scale = 1.0, n @ p
    for _ in range(steps):
        new = np.maximum(y - p @ (((y * n) @ p - aim) / scale), low)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / after * (new - x), after
    return x


def members_of(spark, n, p):
    return spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(n, p)], "n_tokens bigint, posterior array<double>")


@pytest.mark.parametrize("low", [0.0, 0.9])
def test_rates_match_numpy(spark, low):
    r = np.random.default_rng(2)
    n, p = r.integers(1, 500, 300), r.dirichlet((0.3, 0.3, 0.3), 300)
    members = members_of(spark, n, p)
    found = M.fit(members, [0.7, 0.2, 0.1], words=float(n.sum()), low=low, steps=15, close=0.0)
    got = [x.rate for x in members.select(found.rate().alias("rate")).collect()]
    assert np.allclose(got, brute(n, p, n.sum() * np.array([0.7, 0.2, 0.1]), low, 15))


@pytest.mark.parametrize("low", [0.0, 1.0])
def test_a_rare_and_a_frequent_domain_reach_their_targets(spark, low):
    """0.5 % of the words shall be 20 %, and 90 % of them 10 %: rates of 40 and more."""
    r = np.random.default_rng(3)
    p = np.vstack((r.dirichlet((1, 30, 0.3), 900), r.dirichlet((30, 1, 0.3), 95), r.dirichlet((0.5, 0.5, 20), 5)))
    n = r.integers(50, 150, 1000)
    members = members_of(spark, n, p)
    found = M.fit(members, [0.7, 0.1, 0.2], low=low)
    rate = np.array([x.rate for x in members.select(found.rate().alias("rate")).collect()])
    aim = np.array(found.target)
    assert np.allclose((rate * n) @ p, aim, atol=2e-3 * aim.sum()) and np.allclose(found.reached, (rate * n) @ p, rtol=1e-6)
    assert rate.min() >= low and rate.max() > 16 and np.allclose(aim / aim.sum(), [0.7, 0.1, 0.2])


def test_posteriors_match_a_count_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "c d"), (3, "a c c"), (4, None)], "doc_id bigint, text string")
    labelled = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, domain string")
    model = M.learn(docs, labelled, ["x", "y"])
    bucket = {r.w: r.b[0] for r in spark.createDataFrame([(w,) for w in "abcd"], "w string").selectExpr("w").withColumn("b", M.buckets(M.F.col("w"))).collect()}
    seen = {"x": {}, "y": {}}
    for d, text in (("x", "aab"), ("y", "cd")):
        for w in text:
            seen[d][bucket[w]] = seen[d].get(bucket[w], 0) + 1
    for r in M.memberships(docs, model).collect():
        w = (r.text or "").split()
        z = [math.log(0.5) + sum(math.log((seen[d].get(bucket[x], 0) + 0.5) / (sum(seen[d].values()) + 0.5 * M.BUCKETS)) for x in w) / math.sqrt(max(len(w), 1)) for d in "xy"]
        want = np.exp(z) / np.exp(z).sum()
        assert np.allclose(r.posterior, want, atol=1e-3)


def test_awkward_rows(spark):
    df = awkward(spark).withColumnRenamed("hash", "rate")
    labels = spark.createDataFrame([(4, 1, 0), (14, 0, 0), (7, 1, 1), (None, 1, 1), (8, None, None), (999, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = M.mix(df, M.domains_of(labels), M.TARGETS).collect()
    assert len(rows) == df.count() and all(r.rate >= 0 and not math.isnan(r.rate) for r in rows)
    again = M.resample(df, M.domains_of(labels), M.TARGETS)
    assert again.columns == df.columns and {r.doc_id for r in again.collect()} == {r.doc_id for r in rows}
    flat = M.mix(df, M.domains_of(labels.limit(0)), {"a": 1.0, "b": 1.0}).collect()
    assert all(p == pytest.approx(0.5) for r in flat for p in r.posterior)
    assert M.mix(df.limit(0), M.domains_of(labels), M.TARGETS).count() == 0
    with pytest.raises(ValueError):
        M.mix(df, M.domains_of(labels), {})
