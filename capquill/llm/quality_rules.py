"""Quality rules (operator 10): text statistics, and a decision list learned from labelled ones.

`statistics` counts over each whole text in vectorized batches. `learn` runs sequential covering on a
bounded sample of labelled statistics: each rule grows by the threshold test with the best FOIL gain on
two thirds of the rows and is pruned on the rest; rules for the bad class are listed in order and the
default is good. `DecisionList.column` is one ordered CASE expression, so Spark applies it natively.

Nulls and ties: a null text has no words, so all counts are 0; a row without doc_id is kept and scored;
repeated rows are scored each; labels with a null, for unknown documents or other than 0/1 are not used,
and repeated labels for one document count as one (the worst). An empty table, or labels of one class
only, give an empty list of rules, which accepts everything that the base rules accept. Other columns of
the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm import kernels as K
from capquill.llm.common import KEEP, columns_or_null, sampled, table

WINDOW = 8
#: Labelled rows that are used for learning at most (the first in the order of a hash of doc_id).
SAMPLE = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_marks", "n_lines")
_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)

_SPACES = b" \t\n\v\f\r"
_SYMBOL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?")] = True


def _per_document(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeated_words(w: K.Words, document: np.ndarray) -> np.ndarray:
    """Words inside an 8-word window that its own text holds twice or more, for each document."""
    starts = np.flatnonzero(K.whole_windows(w.first, WINDOW))
    h = K.window_hashes(w.hash, WINDOW)[starts] ^ K.mix(document[starts].astype(np.uint64))
    order = np.argsort(h)
    h = h[order]
    twin = np.zeros(len(h), bool)
    twin[1:] = h[1:] == h[:-1]
    twin[:-1] |= twin[1:].copy()
    edge = np.zeros(len(w.hash) + 1, np.int64)
    hit = starts[order[twin]]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return _per_document(np.cumsum(edge[:-1]) > 0, w.first)


def _repeated_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, for each document."""
    n = len(off) - 1
    worded, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = data.tobytes()
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip(_SPACES)]
        worded[i], again[i] = len(lines), len(lines) - len(set(lines))
    return worded, again


def _counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    w = K.words(data, off)
    points = (data & 0xC0) != 0x80
    lines, again = _repeated_lines(data, off)
    return [
        np.diff(w.first),
        _per_document(points & ~K.WHITESPACE[data], off),
        _per_document(_SYMBOL[data], off),
        again,
        _repeated_words(w, w.document()),
        _per_document(points, off),
        _per_document((data >= 65) & (data <= 90), off),
        _per_document((data >= 48) & (data <= 57), off),
        _per_document(_MARK[data], off),
        lines,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_counts(data, off) for _, data, off in K.chunks(batch.column(1))]
        if parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True))], names=["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of COUNTS for each document."""
    return columns_or_null(docs, doc_id="bigint", text="string").mapInArrow(_statistics, _SCHEMA)


#: Name -> (numerator, denominator) of the statistics that rules may test.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"), "upper_ratio": ("n_upper", "word_chars"), "digit_ratio": ("n_digits", "word_chars"), "mark_ratio": ("n_marks", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


def ratio(name: str) -> Column:
    over, under = (F.col(c).cast("double") for c in RATIOS[name])
    return over / F.greatest(under, F.lit(1.0))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return ratio(self.name) >= self.threshold if self.above else ratio(self.name) < self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(RATIOS).index(self.name)]
        return v >= self.threshold if self.above else v < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds says that a document is bad, none that it is good."""

    rules: tuple[tuple[Test, ...], ...]

    def column(self) -> Column:
        """Number of the rule that a document falls under, from 1; 0 for the default."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = reduce(lambda a, b: a & b, (t.column() for t in rule))
            out = F.when(holds, k) if out is None else out.when(holds, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"{k}: bad if " + " and ".join(f"{t.name} {'>=' if t.above else '<'} {t.threshold:.6g}" for t in r) for k, r in enumerate(self.rules, 1)) or "no rules"


def _candidates(x: np.ndarray) -> Iterator[Test]:
    for j, name in enumerate(RATIOS):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))
        for t in (values[1:] + values[:-1]) / 2:
            yield Test(name, True, float(t))
            yield Test(name, False, float(t))


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[Test]:
    rule: list[Test] = []
    while len(rule) < most and not bad.all():
        p0, best, gain = max(bad.mean(), 1e-9), None, 1e-9
        for t in _candidates(x):
            in_ = t.holds(x)
            p = int(bad[in_].sum())
            if p and (g := p * (np.log2(p / in_.sum()) - np.log2(p0))) > gain:
                best, gain = t, g
        if best is None:
            break
        rule.append(best)
        in_ = best.holds(x)
        x, bad = x[in_], bad[in_]
    return rule


def _covered(rule: list[Test], x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (t.holds(x) for t in rule), np.ones(len(x), bool))


def learn_list(x: np.ndarray, bad: np.ndarray, *, precision: float = 0.9, least: int = 5, most_tests: int = 3, most_rules: int = 12) -> DecisionList:
    """Sequential covering over rows of the RATIOS, in their order; a rule stays if its precision on the pruning rows reaches `precision`."""
    rules: list[tuple[Test, ...]] = []
    grow = np.arange(len(x)) % 3 != 2
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and bad[left & grow].any():
        rule = _grow(x[left & grow], bad[left & grow], most_tests)
        px, pbad = x[left & ~grow], bad[left & ~grow]

        def worth(r: list[Test]) -> float:
            in_ = _covered(r, px)
            good, wrong = int((in_ & pbad).sum()), int((in_ & ~pbad).sum())
            return (good - wrong) / max(good + wrong, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        in_ = _covered(rule, x) & left if rule else np.zeros(len(x), bool)
        check = in_ & ~grow if (in_ & ~grow).sum() >= least else in_
        if in_.sum() < least or bad[check].mean() < precision:
            break
        rules.append(tuple(rule))
        left &= ~in_
    return DecisionList(tuple(rules))


def learn(counts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Rules for quality 0 against 1, from the statistics of at most `sample` labelled documents."""
    known = columns_or_null(labels, doc_id="bigint", quality="int").where("quality in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = sampled(known, "doc_id", sample).join(counts, "doc_id").select("doc_id", "quality", *[ratio(r).alias(r) for r in RATIOS], F.xxhash64("doc_id").alias("at")).toPandas()
    rows = rows.sort_values(["at", "doc_id", *RATIOS])
    return learn_list(rows[list(RATIOS)].to_numpy(float), rows["quality"].to_numpy() == 0)


def judge(counts: DataFrame, rules: DecisionList) -> DataFrame:
    """The counts with base_failed, rule (number of the learned rule, 0: none) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("rule", rules.column()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = statistics(table(spark, sf_dir, "documents")).persist(KEEP)
    rules = learn(counts, table(spark, sf_dir, "labels"))
    return judge(counts, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
