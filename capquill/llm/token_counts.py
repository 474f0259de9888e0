"""Token counts (operator 12): byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Each task cuts its texts into pre-tokens, and merges those it has not met before all at once: the symbols of all of them
stand in one array, every round applies the lowest-rank pair of each sequence wherever it stands in that sequence, and
sequences without a pair left leave the array. A count is the number of symbols that survive. Texts never leave their
task, so there is no shuffle; a text is cut in pieces as it is read, so a long one takes no more memory than a short one.

Any vocabulary file of the `tokenizers` library will do whose model is a byte-level BPE with the usual pattern and without a
normalizer; others are refused with ValueError. The driver reads the file (its path is a parameter) and sends arrays of
the vocabulary's size to the tasks.

Nulls and ties: a null text counts as an empty one (0 bytes, 0 tokens); a null doc_id is a document like any other; repeated
rows are counted each; octets that are no UTF-8 count as U+FFFD; an empty table gives no rows. A special token's string inside a
text is that one token, as by the library's default. Other columns of the input are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from capquill.llm.common import columns_or_null, table

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Fixed value: the pattern that byte-level BPE cuts texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of texts that are cut at a time, pre-tokens of a longer text that are, and octets of counted pre-tokens kept.
SLICE, PIECE, REMEMBERED = 2_000_000, 200_000, 8_000_000
NONE = np.iinfo(np.int32).max
OUT = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


@dataclass
class Merges:
    """A vocabulary as arrays: the symbol of each octet, the pairs (left << 32 | right), sorted, their ranks, and the symbol of each rank."""

    octet: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    symbols: np.ndarray
    specials: list[str]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no such pair."""
        if not len(self.pairs):
            return np.full(len(left), NONE, np.int32)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NONE)


def octet_letters() -> list[str]:
    """The letter that stands for each octet in the vocabulary: itself if printable, else one from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in printable else next(hidden)) for b in range(256)]


def read_vocabulary(path: str) -> Merges:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"]
    simple = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    flagged = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model["type"] != "BPE" or not plain or not simple or flagged:
        raise ValueError(f"{path} is no plain byte-level BPE")
    ids = model["vocab"]
    sides = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([ids[a] << 32 | ids[b] for a, b in sides], np.int64)
    symbols = np.array([ids[a + b] for a, b in sides], np.int64)
    order = np.argsort(pairs, kind="stable")
    octet = np.array([ids[x] for x in octet_letters()], np.int64)
    return Merges(octet, pairs[order], order.astype(np.int32), symbols, [t["content"] for t in spec["added_tokens"]])


def count_symbols(words: list[bytes], m: Merges) -> np.ndarray:
    """Symbols that each word ends up with, all words merged in lock step."""
    length = np.array([len(w) for w in words], np.int64)
    left_over = np.zeros(len(words), np.int64)
    names = np.flatnonzero(length)  # empty words stay at 0
    length = length[names]
    ids = m.octet[np.frombuffer(b"".join(words), np.uint8)]
    starts = np.cumsum(length) - length
    ranks = np.full(len(ids), NONE, np.int32)
    ranks[:-1] = m.rank(ids[:-1], ids[1:])
    ranks[starts + length - 1] = NONE  # the last symbol of a word has no right neighbour
    while len(names):
        best = np.minimum.reduceat(ranks, starts)
        ended = best == NONE
        if ended.any():
            left_over[names[ended]] = length[ended]
            stays = np.repeat(~ended, length)
            ids, ranks = ids[stays], ranks[stays]
            names, length, best = names[~ended], length[~ended], best[~ended]
            if not len(names):
                break
            starts = np.cumsum(length) - length
        hit = np.flatnonzero(ranks == np.repeat(best, length))
        # Of a run such as aaaa, every other pair is applied, from the left.
        opens = np.concatenate([[True], np.diff(hit) != 1])
        run = hit[opens][np.cumsum(opens) - 1]
        hit = hit[(hit - run) % 2 == 0]
        ids[hit] = m.symbols[ranks[hit]]
        ranks[hit] = ranks[hit + 1]  # NONE where the merged pair ends its word, else renewed below
        stays = np.ones(len(ids), bool)
        stays[hit + 1] = False
        gone = np.add.reduceat(~stays, starts)
        is_last = np.zeros(len(ids), bool)
        is_last[starts + length - 1] = True
        is_last[hit] |= is_last[hit + 1]
        ids, ranks, is_last = ids[stays], ranks[stays], is_last[stays]
        length = length - gone
        starts = np.cumsum(length) - length
        at = hit - np.arange(len(hit))
        at = np.unique(np.concatenate([at, at[at > 0] - 1]))
        at = at[~is_last[at]]
        ranks[at] = m.rank(ids[at], ids[at + 1])
    return left_over


class Counter:
    """Counts of texts; pre-tokens that were counted before are remembered, up to a bound of octets."""

    def __init__(self, m: Merges):
        self.merges, self.known, self.held = m, {}, 0
        self.cut = regex.compile(PATTERN)
        longest_first = sorted(m.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if m.specials else None

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        if new:
            raw = [w.encode() for w in new]
            self.held += sum(map(len, raw))
            self.known.update(zip(new, count_symbols(raw, self.merges).tolist()))

    def forget(self) -> None:
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0

    def long_text(self, text: str) -> int:
        total, found = 0, self.cut.finditer(text)
        while words := [w.group() for w in islice(found, PIECE)]:
            self.learn(set(words))
            total += sum(map(self.known.__getitem__, words))
            self.forget()
        return total

    def counts(self, texts: list[str]) -> list[int]:
        total, cut = [0] * len(texts), []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special and self.special.search(text) else [text]
            total[i] = len(parts) - 1
            for part in parts:
                if len(part) > SLICE:
                    total[i] += self.long_text(part)
                else:
                    cut.append((i, self.cut.findall(part)))
        self.learn(set().union(*(words for _, words in cut)))
        for i, words in cut:
            total[i] += sum(map(self.known.__getitem__, words))
        self.forget()
        return total


def slices(raw: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, a bounded number of characters at a time."""
    some, size = [], 0
    for value in raw:
        some.append((value.as_py() or b"").decode("utf-8", "replace"))
        size += len(some[-1])
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def counter_of(m: Merges, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(m)
        for batch in batches:
            tokens = [n for some in slices(batch.column(2)) for n in counter.counts(some)]
            over = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document, by the vocabulary file at the path."""
    d = columns_or_null(docs, doc_id="bigint", text="string")
    d = d.selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) as bigint) as n_bytes", "cast(text as binary) as raw")
    return d.mapInArrow(counter_of(read_vocabulary(path), limit), OUT)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
