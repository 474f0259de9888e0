"""Language identification (operator 9): averaged hashed subword embeddings under a linear softmax.

A document is the mean of the embeddings of its hashed byte n-grams (letters in lower case, everything
else a blank); a linear softmax over that mean gives the posteriors. Both layers are trained by plain
stochastic gradient descent in numpy on a bounded sample of labelled rows. Since the classifier is linear
in the mean, embeddings and weights fold into one table of a score per bucket and language, which tasks
look up over whole texts. A temperature is fitted on rows kept out of the training, and with it the
rejection threshold: the confidence that all but `REJECT` of those rows that are predicted rightly reach, at most one half.

Nulls and ties: a null or letterless text is `und` with score 0 and is rejected; a null doc_id counts as
not held out and is never learned from; rows with a null lang are predicted, not learned; repeated rows
are predicted each. Equal scores go to the first language in sorted order. With no labelled rows every
text is `und`. Columns that clash with the added ones are replaced, all others are passed on by `identify`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capquill.llm import kernels as K
from capquill.llm.common import columns_or_null, table

#: Bounds of the training sample: documents of each language, and bytes of a document if the language has shorter ones.
PER_LANGUAGE, MOST_BYTES = 500, 20_000
BUCKETS, DIMENSIONS, ORDERS = 1 << 16, 16, (2, 3, 4)
#: Share of calibration rows that the rejection threshold may turn away.
REJECT = 0.001

_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets of the n-grams in order, first n-gram of each document) for each n of ORDERS."""
    letters = _LETTER[data]
    values = K.BYTE_VALUES[letters]
    blank = letters == 32
    pairs = np.zeros(max(len(data), 1), np.int64)
    np.cumsum(blank[:-1] & blank[1:], out=pairs[1:])
    out = []
    for n in ORDERS:
        grams = K.window_hashes(values, n)
        good = K.whole_windows(off, n)
        good &= pairs[n - 1 : n - 1 + len(grams)] == pairs[: len(grams)]
        at = np.flatnonzero(good)
        out.append(((grams[at] & np.uint64(BUCKETS - 1)).astype(np.int32), np.searchsorted(at, off)))
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, and its number of n-grams."""
        total, count = np.zeros((len(off) - 1, len(self.languages))), np.zeros(len(off) - 1, np.int64)
        for buckets, first in subwords(data, off):
            some = np.flatnonzero(first[1:] > first[:-1])
            if len(some):  # each document for itself, so that its neighbours don't change the last digits
                total[some] += np.add.reduceat(self.scores[buckets], first[some], axis=0, dtype=np.float64)
            count += np.diff(first)
        return total / np.maximum(count, 1)[:, None] + self.bias, count


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _train(examples: list[list[np.ndarray]], target: np.ndarray, n: int, *, epochs: int, rate: float, crop: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    emb = (rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, n)), np.zeros(n)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            size = int(crop ** rng.uniform(0.4, 1))  # short pieces as well, so that short texts are known
            at = rng.random()
            pieces = [g[max(0, int(at * (len(g) - size))) :][:size] for g in examples[k]]
            buckets, times = np.unique(np.concatenate(pieces), return_counts=True)
            step += 1
            if not len(buckets):
                continue
            share = times / times.sum()
            mean = share @ emb[buckets]
            error = softmax(mean @ out + bias)
            error[target[k]] -= 1
            lr = rate * (1 - step / (steps + 1))
            back = out @ error
            out -= lr * np.outer(mean, error)
            bias -= 0.01 * lr * error
            emb[buckets] -= (100 * lr) * share[:, None] * back
    return emb, out, bias


def learn(rows: list[tuple[str, str]], *, epochs: int = 6, rate: float = 0.5, crop: int = 800, seed: int = 7) -> Model:
    """A model from (lang, text) rows; every fifth row is kept for calibration."""
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    target = np.array([languages.index(lang) for lang, _ in rows])
    texts = [t.encode() for _, t in rows]
    examples = [[b for b, _ in subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)]))] for t in texts]
    kept_out = np.arange(len(rows)) % 5 == 4
    use = np.flatnonzero(~kept_out)
    emb, out, bias = _train([examples[i] for i in use], target[use], len(languages), epochs=epochs, rate=rate, crop=crop, seed=seed)
    model = Model(languages, (emb @ out).astype(np.float32), bias, 1.0, 0.0)
    if not kept_out.any():
        return model
    z = np.concatenate([model.logits(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0] for i in np.flatnonzero(kept_out)])
    true = target[kept_out]
    loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), true], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
    temperature = float(min(loss, key=loss.get))
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == true]
    return Model(languages, model.scores, bias, temperature, min(0.5, float(np.quantile(right, REJECT))) if len(right) else 0.5)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """At most PER_LANGUAGE labelled texts of every language, picked by a hash of doc_id; a language without a text of up to MOST_BYTES gives longer ones."""
    d = columns_or_null(docs, doc_id="bigint", text="string", lang="string")
    d = d.where("doc_id is not null and lang is not null and lang <> 'und' and text <> ''").where(~held_out())
    d = d.withColumn("short", F.octet_length("text") <= MOST_BYTES).withColumn("at", F.xxhash64("doc_id"))
    counts = d.groupBy("lang").agg(F.count("*").alias("all"), F.count_if("short").alias("shorts"))  # a row for each language
    share = F.least(F.lit(1.0), 2 * PER_LANGUAGE / F.when(F.col("shorts") > 0, F.col("shorts")).otherwise(F.col("all")))
    wanted = counts.select("lang", share.alias("share"), (F.col("shorts") > 0).alias("has_short"))
    d = d.join(F.broadcast(wanted), "lang").where((F.col("short") == F.col("has_short")) & (F.pmod("at", F.lit(1_000_000)) < F.col("share") * 1_000_000))
    by = defaultdict(list)
    for r in d.select("lang", "text", "at", "doc_id").sort("at", "doc_id", "text").select("lang", "text").toLocalIterator():
        if len(by[r["lang"]]) < PER_LANGUAGE:
            by[r["lang"]].append((r["lang"], r["text"]))
    rows = [x for lang in sorted(by) for x in by[lang]]
    return [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(batches: Iterator[pa.RecordBatch], model: Model, names: list[str]) -> Iterator[pa.RecordBatch]:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[97:123] = ascii_letter[65:91] = True
    for batch in batches:
        text = batch.column("text")
        best, score = np.full(len(text), -1), np.zeros(len(text))
        for a, data, off in K.chunks(text) if model.languages else ():
            z, _ = model.logits(data, off)
            p = softmax(z / model.temperature)
            sure = np.zeros(len(data) + 1, np.int64)
            np.cumsum(ascii_letter[data], out=sure[1:])
            lettered = sure[off[1:]] > sure[off[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(off) > 0)):
                lettered[i] = _has_letter(text[a + int(i)].as_py())
            here = slice(a, a + len(off) - 1)
            best[here] = np.where(lettered, p.argmax(axis=1), -1)
            score[here] = np.where(lettered, p.max(axis=1), 0)
        lang = np.array([*model.languages, "und"], object)[best]
        added = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.clip(score, 0, 1)), "accepted": pa.array((best >= 0) & (score >= model.threshold))}
        yield pa.RecordBatch.from_arrays([added.get(n, batch.column(n) if n in batch.schema.names else None) for n in names], names=names)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred, score (calibrated confidence) and accepted."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "accepted": T.BooleanType()}
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added.items())])
    names = schema.names
    return docs.mapInArrow(lambda it: _predict(it, model, names), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with all their columns as they are."""
    added = ("lang_pred", "score", "accepted")
    held = docs.withColumnsRenamed({c: f"_of_{c}" for c in added if c in docs.columns})
    own = [F.col(f"`_of_{c}`").alias(c) if c in added else F.col(f"`{c}`") for c in docs.columns]
    return identify(held, model).where(F.col("accepted")).select(*own)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
