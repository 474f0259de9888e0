"""Mixing sources to target weights (operator 4): soft memberships and rates, in DataFrame operations only.

A naive Bayes classifier over hashed words is counted from a bounded sample of labelled rows and predicts a
posterior over domains for each document (the log likelihood is divided by the root of the word count, which
keeps memberships soft). Then nonnegative rates are fitted by projected-gradient least squares such that the
expected words of each domain, sum of rate * words * posterior, match the targets. The gradient of a rate is a
function of the document's posterior and of one residual per domain, so an iteration is one update of each
document's state (rate and momentum point) and one pre-aggregated sum; only that sum meets the driver. Residuals are
taken relative to the words that a domain has, so that a rare domain is fitted as fast as a frequent one, at step size 1.

Nulls and ties: a null or blank text has no words, the prior as posterior and a rate like any other; a null
doc_id is kept; repeated rows are rated each. Labels without a document, with a null or of a domain that has
no target are not used; a domain without a labelled word is predicted by its smoothed prior. Without
any labels all domains are equally likely. Empty tables give no rows. `resample` passes other columns on; the
added ones replace those of the same name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm.common import KEEP, columns_or_null, cut, sampled, table

#: Word buckets, and labelled rows that are learned from at most (picked by a hash of doc_id).
BUCKETS, SAMPLE = 2048, 20_000
#: Steps after which fitting ends though the targets are not reached; the result tells what was.
STEPS = 300
#: Steps after which the state is cut from its lineage.
CUT = 10
TARGETS = {"good": 0.7, "poor": 0.1, "toxic": 0.2}
_NOT_WORD = r"[\x09-\x0D\x20]+"


def buckets(text: Column) -> Column:
    """The bucket of each word of a text."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")
    return F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, or else good or poor by quality."""
    d = columns_or_null(labels, doc_id="bigint", quality="int", toxic="int")
    return d.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    prior: tuple[float, ...]
    #: For each domain the log likelihood of each bucket, against the mean over domains.
    scores: tuple[tuple[float, ...], ...] = field(repr=False)

    def logits(self, of: str, n: str) -> Column:
        """array<double>, in the order of the domains, from the columns of the buckets and of their number."""

        def logit(prior: float, scores: tuple[float, ...]) -> Column:
            known = F.from_json(F.lit(json.dumps(scores)), "array<double>")
            total = F.aggregate(of, F.lit(0.0), lambda a, b: a + F.get(known, b))
            return F.lit(prior) + total / F.sqrt(F.greatest(F.col(n), F.lit(1)).cast("double"))

        return F.array(*[logit(p, s) for p, s in zip(self.prior, self.scores, strict=True)])


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> Classifier:
    """From (doc_id, domain) rows, at most `sample` of them."""
    import math

    docs = columns_or_null(docs, doc_id="bigint", text="string")
    some = sampled(labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)), "doc_id", sample)
    b = docs.join(F.broadcast(some), "doc_id").select("domain", F.explode(buckets(F.col("text"))).alias("bucket"))
    counts = {d: [0.0] * BUCKETS for d in domains}
    for r in b.groupBy("domain", "bucket").count().collect():
        counts[r["domain"]][r["bucket"]] = float(r["count"])
    rows = {r["domain"]: r["count"] for r in some.groupBy("domain").count().collect()}
    logs = [[math.log((x + 0.5) / (sum(counts[d]) + 0.5 * BUCKETS)) for x in counts[d]] for d in domains]
    mean = [sum(x) / len(domains) for x in zip(*logs, strict=True)]
    prior = [math.log((rows.get(d, 0) + 1) / (sum(rows.values()) + len(domains))) for d in domains]
    return Classifier(tuple(domains), tuple(prior), tuple(tuple(round(x - m, 4) for x, m in zip(log, mean, strict=True)) for log in logs))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row: what comes later isn't merged into their expressions."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """The documents with n_tokens and posterior."""
    out = _once(docs, _b=buckets(F.col("text").cast("string"))).withColumn("n_tokens", F.size("_b").cast("bigint"))
    out = _once(out, _z=model.logits("_b", "n_tokens")).drop("_b")
    out = _once(out, _e=F.transform("_z", lambda x: F.exp(x - F.array_max("_z")))).drop("_z")
    return _once(out, posterior=F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).drop("_e")


def _dot(residual: list, size: int) -> Column:
    return sum((F.col("posterior")[k] * residual[k] for k in range(size)), F.lit(0.0))


@dataclass(frozen=True)
class Fit:
    #: Of each step [momentum, one residual per domain].
    steps: list[list[float]]
    low: float
    size: int
    #: Expected words of each domain under the rates, and what was aimed at.
    reached: tuple[float, ...] = ()
    target: tuple[float, ...] = ()

    def rate(self) -> Column:
        """The rate of a document by its posterior: the steps, taken one after the other."""
        start = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
        if not self.steps:
            return F.lit(1.0)

        def step(at: Column, s: Column) -> Column:
            x = F.greatest(F.lit(self.low), at["y"] - _dot([s[k + 1] for k in range(self.size)], self.size))
            return F.struct(x.alias("x"), (x + s[0] * (x - at["x"])).alias("y"))

        return F.aggregate(F.from_json(F.lit(json.dumps(self.steps)), "array<array<double>>"), start, step)["x"]


def fit(members: DataFrame, weights: list[float], *, words: float | None = None, low: float = 0.0, steps: int = STEPS, close: float = 1e-3) -> Fit:
    """Rates of at least `low` for members (n_tokens, posterior): the words of domain k shall be words * weights[k].

    Without `words`: as many as there are, or, if rates can't be less than `low` and this asks for more, a tenth more than
    rates of the form low + sum of c[k] * posterior[k] need to meet the targets with c >= 0.
    """
    k = len(weights)
    one = F.lit(1.0)
    state = cut(members.select(F.col("n_tokens").cast("double").alias("n"), "posterior", one.alias("x"), one.alias("y")))

    def expected(of: DataFrame, rate: str) -> list[float]:
        sums = of.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(rate) * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)]).first()
        return [float(v or 0.0) for v in sums]

    total, *sums = expected(state, "y")
    share = [w / sum(weights) for w in weights]
    if words is None:
        words = total
        if low and total:
            pairs = [F.sum(F.col("n") * F.col("posterior")[i] * F.col("posterior")[j]) for i in range(k) for j in range(k)]
            needs = np.linalg.lstsq(np.array(state.agg(*pairs).first(), float).reshape(k, k), np.array(share), rcond=None)[0]
            least = needs.min() if needs.min() > 0 else min(w / (2 * s) for w, s in zip(share, sums, strict=True) if s)
            words = max(total, 1.1 * low / least) if least > 0 else total
    aim = [words * w for w in share]
    scale = [max(s, 1e-9 * max(total, 1.0)) for s in sums]
    done: list[list[float]] = []
    t = 1.0
    while len(done) < steps and total:
        if max(abs(s - a) for s, a in zip(sums, aim, strict=True)) < close * sum(aim):
            break
        residual = [(s - a) / c for s, a, c in zip(sums, aim, scale, strict=True)]
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum, t = (t - 1) / after, after
        done.append([momentum, *residual])
        moved = state.withColumn("new", F.greatest(F.lit(low), F.col("y") - _dot(residual, k)))
        moved = moved.select("n", "posterior", F.col("new").alias("x"), (F.col("new") + momentum * (F.col("new") - F.col("x"))).alias("y"))
        moved = cut(moved) if len(done) % CUT == 0 else moved.persist(KEEP)
        _, *sums = expected(moved, "y")
        state.unpersist()
        state = moved
    reached = tuple(expected(state, "x")[1:])
    state.unpersist()
    return Fit(done, low, k, reached, tuple(aim))


def _model_and_fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], words_factor: float | None, low: float) -> tuple[Classifier, DataFrame, Fit]:
    domains = sorted(targets)
    if not domains or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets need nonnegative weights with a positive sum")
    model = learn(docs, labelled, domains)
    plain = memberships(columns_or_null(docs, doc_id="bigint", text="string"), model).select("doc_id", "n_tokens", "posterior").persist(KEEP)
    words = None if words_factor is None else words_factor * (plain.agg(F.sum("n_tokens")).first()[0] or 0)
    return model, plain, fit(plain, [targets[d] for d in domains], words=words, low=low)


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, words_factor: float | None = None, low: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, posterior and rate of each document; `reached` and `target` are the expected words of each domain in all, in the order of the names."""
    _, plain, found = _model_and_fit(docs, labelled, targets, words_factor, low)
    both = (F.array(*map(F.lit, x)).alias(n) for n, x in (("reached", found.reached), ("target", found.target)))
    return _once(plain, rate=found.rate()).select("*", *both)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, words_factor: float | None = None, low: float = 0.0) -> DataFrame:
    """The documents, with all their columns, with n_tokens, posterior and rate."""
    model, plain, found = _model_and_fit(docs, labelled, targets, words_factor, low)
    plain.unpersist()
    return _once(memberships(docs.drop("n_tokens", "posterior", "rate"), model), rate=found.rate())


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, words_factor: float | None = None, low: float = 1.0) -> DataFrame:
    """Each document floor(rate) times, and once more with the probability of the rest, by a hash of doc_id and text; just its own columns."""
    model, plain, found = _model_and_fit(docs, labelled, targets, words_factor, low)
    plain.unpersist()
    names = ("n_tokens", "posterior", "rate")
    held = docs.withColumnsRenamed({c: f"_of_{c}" for c in names if c in docs.columns})
    mixed = _once(memberships(held, model), rate=found.rate())
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    times = F.floor(F.col("rate") + chance).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    own = [F.col(f"`_of_{c}`").alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns]
    return mixed.select(*own, F.explode(copies).alias("_k")).drop("_k")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = rates(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))], "rate", *[F.col(c)[i].alias(f"{c}_{d}") for c in ("reached", "target") for i, d in enumerate(sorted(TARGETS))])
