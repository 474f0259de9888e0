"""Embedding whitening (operator 13): principal components by hierarchical merging of singular value decompositions.

A partition centres its vectors at their own mean and keeps all singular values and vectors (as rows: value times
vector), the exact integer sums and the count. Two such summaries merge without loss: their rows, and one more row, the
difference of the means times sqrt(n m / (n + m)), are decomposed again. Merging goes in a tree of bounded fan-in, so no task
sees more than FAN summaries of dimension x dimension numbers, and the last one goes to the driver. Eigenvalues of the
covariance are the squared singular values over n. Rows are then whitened where they lie; only the summaries are shuffled.

Entries are read as numbers of fixed point: x = floor(SCALE * c) + SHIFT. Nulls and ties: a vector that is null, is
empty, or holds a null, NaN, an infinite entry or one of 2**40 or more (its x is not exact as a double) is dropped; so is one of
another length than most (of lengths as frequent, the longest counts). A null vec_id is a row like any other; repeated
rows are kept and count each. Components without variance (a singular value of at most 1e-12 of the largest) cannot be
whitened and are not given out: a single vector, or equal ones, give no rows, as does an empty table. Of components of
equal variance any rotation may come out, the same for all rows. A deviation beyond 64 bits is null. Other columns of the
input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm.common import columns_or_null, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Summaries that one task merges, numbers of a block that is decomposed at once, and the least relative singular value.
FAN, BLOCK, LEAST = 16, 1_000_000, 1e-12
MOST_ENTRY = 2.0**40
SUMMARY = "item bigint, n bigint, sums array<bigint>, factor array<double>"


@dataclass
class Summary:
    """n vectors: their exact sums, and rows R for which transpose(R) R is their scatter about the mean."""

    n: int
    sums: list[int]
    rows: np.ndarray


def decompose(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors, as rows, largest first."""
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values[:, None] * vectors


def merged(parts: Iterable[Summary]) -> Summary:
    parts = list(parts)
    n, sums, stack = parts[0].n, parts[0].sums, [parts[0].rows]
    for p in parts[1:]:
        # n * m * (mean - other mean), exact in Python's integers
        gap = np.array([float(b * n - a * p.n) for a, b in zip(sums, p.sums, strict=True)])
        stack += [p.rows, gap[None, :] / np.sqrt(float(n) * p.n * (n + p.n))]
        n, sums = n + p.n, [a + b for a, b in zip(sums, p.sums, strict=True)]
    return Summary(n, sums, decompose(np.concatenate(stack)))


def summarized(x: np.ndarray) -> Summary:
    n, sums = len(x), x.sum(axis=0)
    whole, part = np.divmod(sums, n)
    return Summary(n, sums.tolist(), decompose((x - whole) - part / n))


def usable(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a batch's usable vectors, and the vectors as integers."""
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    right = np.flatnonzero(lengths == d)
    taken = vectors.take(pa.array(right))
    flat = taken.flatten().cast(pa.float64()).fill_null(np.nan)
    c = np.asarray(flat).reshape(len(right), d)
    fine = (np.abs(c) < MOST_ENTRY).all(axis=1)  # false for NaN
    return right[fine], np.floor(c[fine] * SCALE).astype(np.int64) + SHIFT


def _summaries(d: int):
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, block, held = None, [], 0

        def close():
            now = summarized(np.concatenate(block))
            return merged([done, now]) if done else now

        for batch in batches:
            _, x = usable(batch, d)
            for at in range(0, len(x), max(1, BLOCK // d)):
                block.append(x[at : at + max(1, BLOCK // d)])
                held += block[-1].size
                if held >= BLOCK:
                    done, block, held = close(), [], 0
        if held:
            done = close()
        if done:
            item = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"item": item, "n": done.n, "sums": done.sums, "factor": done.rows.ravel().tolist()}], SCHEMA)

    return summarize


SCHEMA = pa.schema([("item", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("factor", pa.list_(pa.float64()))])


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("item")
    parts = [Summary(int(n), [int(x) for x in s], np.asarray(f).reshape(-1, len(s))) for n, s, f in zip(pdf["n"], pdf["sums"], pdf["factor"], strict=True)]
    m = merged(parts)
    return pd.DataFrame({"item": [key[0]], "n": [m.n], "sums": [m.sums], "factor": [m.rows.ravel()]})


@dataclass
class Whitening:
    """What rows are whitened by: n, exact sums, eigenvalues (largest first), unit eigenvectors as rows, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def dimension(vectors: DataFrame) -> int | None:
    lengths = vectors.groupBy(F.size("embedding").alias("d")).count().where("d > 0")
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return most and most["d"]


def fit(vectors: DataFrame, d: int, fan: int = FAN) -> Whitening | None:
    """The whitening of all usable vectors of a length; None if there are none."""
    level = vectors.select("embedding").mapInArrow(_summaries(d), SUMMARY)
    parts = vectors.rdd.getNumPartitions()
    while True:
        parts = -(-parts // fan)
        level = level.groupBy(F.floor(F.col("item") / fan).alias("item")).applyInPandas(_merge, SUMMARY)
        if parts == 1:
            break
    found = level.collect()
    if not found:
        return None
    last = found[0]
    rows = np.asarray(last["factor"]).reshape(-1, d)
    # A last decomposition gives the vectors to full precision, free of the values' sizes.
    _, singular, vectors_ = np.linalg.svd(rows, full_matrices=False)
    kept = singular > LEAST * max(1.0, singular[0])
    values = singular**2 / last["n"]
    return Whitening(last["n"], list(last["sums"]), values[kept], vectors_[kept], float(values.sum()))


def _whitener(w: Whitening, d: int, k: int):
    n, most = w.n, np.iinfo(np.int64).max
    whole, part = np.array([divmod(s, n) for s in w.sums], dtype=object).T
    mean_whole, mean_part = whole.astype(np.int64), part.astype(np.float64) / n
    directions = w.vectors[:k].T / np.sqrt(w.values[:k])
    sums = np.array(w.sums, dtype=object)

    def deviation(x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; in 64 bits where they hold it for certain."""
        reach = float(np.abs(x - mean_whole).max(initial=0) + 1) * n
        if reach * reach * d < 2.0**62 and max(w.sums) < 2**62 and float(np.abs(x).max(initial=0)) * n < 2.0**62:
            return ((x * n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        wide = ((x.astype(object) * n - sums) ** 2).sum(axis=1)
        return [v if v <= most else None for v in wide]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch, d)
            white = ((x - mean_whole) - mean_part) @ directions
            lists = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64()))
            ids = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviation(x), pa.int64()), lists], ["vec_id", "deviation", "white"])

    return whiten


def whitened(vectors: DataFrame, w: Whitening, d: int, k: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation and the first k whitened components (or as many as have variance) of each usable vector."""
    return vectors.mapInArrow(_whitener(w, d, k), "vec_id bigint, deviation bigint, white array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of whitened rows minus the identity."""
    w = [F.col("white")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs]
    # The rows are centred exactly before they are projected, so these means are rounding errors.
    got = white.agg(*products, *[F.avg(x).alias(f"m{i}") for i, x in enumerate(w)]).first()
    return max(abs(got[f"p{i}_{j}"] - got[f"m{i}"] * got[f"m{j}"] - (i == j)) for i, j in pairs)


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component, with the share of the variance that the component explains."""
    v = columns_or_null(embeddings, vec_id="bigint", embedding="array<double>")
    d = dimension(v)
    w = fit(v, d) if d else None
    k = min(k, len(w.values)) if w else 0
    if not k:
        return embeddings.sparkSession.createDataFrame([], OUT)
    white = whitened(v, w, d, k)
    error, shares = identity_error(white, k), [float(x / w.trace) for x in w.values[:k]]
    each = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(w.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, shares))[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
