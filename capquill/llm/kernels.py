"""Numpy kernels over Arrow text buffers, shared by the operators that run inside tasks.

All of them work on whole texts, a chunk of documents at a time, without a Python loop over words or
bytes. Hashes of windows are 64-bit polynomials (Rabin-Karp) from prefix sums, finished with a mixer. The
polynomial is taken modulo 2**64, so long runs of few values can collide by their pattern: it serves for
short windows of words, whose values are hashes themselves, and for anchors, which only choose what is compared.
Words get a hash with a state of 128 bits instead, texts a cryptographic one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: The separators of the word class [^\x20\x09-\x0D]+.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] the polynomial of values[i:j], still shifted by the i-th power."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], alike wherever the same values stand."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of each run of `width` values (empty if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = prefix_sums(values)
    return mix((p[width:] - p[:-width]) * powers(n)[1])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive whole texts of about `target` bytes together."""
    data, off = text_buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + target, "right")) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[data]


@dataclass
class Words:
    """Words of a chunk: byte spans, hashes, and the first word of each document (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _eights(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one integer, the first one lowest; zeros follow the end."""
    w = np.zeros(len(data) + 8, np.uint64)
    w[: len(data)] = data
    for step in (1, 2, 4):
        w[:-step] |= w[step:] << U64(8 * step)
    return w


#: Words of more bytes get a cryptographic hash.
LONG_WORD = 64
_LANES = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def text_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes = b"") -> np.ndarray:
    """A 64-bit BLAKE2 digest of each data[start:end]."""
    whole = memoryview(np.ascontiguousarray(data))
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(whole[a:b], digest_size=8, key=key).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end] by its content and length, eight bytes a step in two lanes."""
    size = end - start
    one, two = (size.astype(np.uint64) * k + k for k in _LANES)
    eights = _eights(data)
    at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        left = np.minimum(size[at] - done, 8)
        value = eights[start[at] + done] & (U64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * left).astype(np.uint64))
        one[at] = mix(one[at] ^ value)
        two[at] = mix(two[at] + value * _LANES[1])
        done += 8
        at = at[size[at] > done]
    out = mix(one + two * _LANES[0])
    if len(at := np.flatnonzero(size > LONG_WORD)):
        out[at] = text_hashes(data, start[at], end[at])
    return out


def words(data: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    inside = ~WHITESPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    last = off[1:] - 1
    after[last[last >= 0]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, off), word_hashes(data, start, end))


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """For each of the possible window starts, whether the window stays within one document."""
    total = int(first[-1])
    n = max(total - width + 1, 0)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return document[:n] == document[total - n :] if n else np.empty(0, bool)


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by doubling."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


@dataclass
class Anchors:
    """Runs of consecutive windows that share their anchor, the least hashed k-gram within the window.

    Equal windows have equal anchors at equal places, so windows can only be equal under equal `seed`.
    """

    seed: np.ndarray
    low: np.ndarray  # first window start of the run
    high: np.ndarray  # last window start of the run
    first: np.ndarray  # first run of each document, and one more


def anchors(values: np.ndarray, first: np.ndarray, width: int, k: int) -> Anchors:
    """Anchors of all windows of `width` values, over k-grams of the values."""
    none = np.empty(0, np.int64)
    valid = whole_windows(first, width)
    starts = np.flatnonzero(valid)
    if not len(starts):
        return Anchors(np.empty(0, np.uint64), none, none, np.zeros(len(first), np.int64))
    grams = window_hashes(values, k)
    keys = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_minimum(keys, width - k + 1)[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    low, high = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    return Anchors(grams[owner[at]], low, high, np.searchsorted(low, first))


def merge_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges sorted by `low`, with overlapping and touching ones joined."""
    if not len(low):
        return low, high
    reach = np.maximum.accumulate(high)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return low[at], reach[np.append(at[1:], len(low)) - 1]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
