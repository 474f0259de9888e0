"""Suffix arrays by induced sorting, and permuted common prefixes, a bucket at a time in numpy.

`suffix_array` classifies suffixes as S or L, sorts the leftmost-smaller (LMS) substrings by an induced
pass, names them, orders the text of the names by calling itself and induces the whole array from it. On
bytes the induced passes go through the 256 buckets in order; within a bucket all entries of a round are
handled at once, which keeps the sequential order because a bucket only ever grows at its end. Texts of names have
too many buckets for that: there neighbouring buckets make a part, and what a part induces in itself is put in
its place, given by its bucket and by the place of the suffix right of it, round by round.
"""

from __future__ import annotations

import numpy as np

#: Suffixes in a part of neighbouring buckets, about.
PART = 12_000


def _words8(t: np.ndarray) -> np.ndarray:
    """Eight values from each position as one big-endian integer; zeros follow the end."""
    w = np.zeros(len(t) + 8, np.uint64)
    w[: len(t)] = t
    for step in (1, 2, 4):
        w[:-step] = (w[:-step] << np.uint64(8 * step)) | w[step:]
        w[-step:] <<= np.uint64(8 * step)
    return w


def _s_type(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one; the last one is not."""
    n = len(t)
    settles = np.ones(n, bool)
    settles[:-1] = t[:-1] != t[1:]
    less = np.zeros(n, bool)
    less[:-1] = t[:-1] < t[1:]
    at = np.where(settles, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _deal(buckets: list[list[np.ndarray]], suffixes: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(np.bincount(values, minlength=256))
    suffixes = suffixes[order]
    for c in np.unique(values):
        buckets[c].append(suffixes[ends[c - 1] if c else 0 : ends[c]])


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from the given order of the LMS suffixes."""
    first: list[list[np.ndarray]] = [[] for _ in range(256)]
    starts: list[list[np.ndarray]] = [[] for _ in range(256)]
    first[t[-1]].append(np.array([len(t) - 1]))
    _deal(starts, lms, t[lms])
    present = np.flatnonzero(np.bincount(t, minlength=256))
    large: dict[int, np.ndarray] = {}
    small: dict[int, np.ndarray] = {}

    def rounds(c: int, buckets: list[list[np.ndarray]], kind: bool) -> np.ndarray:
        done, now = [], _join(buckets[c])
        while len(now):
            done.append(now)
            now = now[now > 0] - 1
            now = now[s_type[now] == kind]
            values = t[now]
            own = values == c
            _deal(buckets, now[~own], values[~own])
            now = now[own]
        return _join(done)

    for c in present:
        large[c] = rounds(c, first, False)
        before = _join(starts[c]) - 1
        _deal(first, before, t[before])
    last: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c in present[::-1]:
        small[c] = rounds(c, last, True)
        before = large[c][::-1]
        before = before[before > 0] - 1
        before = before[s_type[before]]
        _deal(last, before, t[before])
    return _join([x for c in present for x in (large[c], small[c][::-1])])


def _equal_neighbours(t: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each t[at:at+length] but the first equals the one before it in `at`."""
    w = _words8(t)
    pairs = np.flatnonzero(length[1:] == length[:-1])
    same = np.zeros(len(at) - 1, bool)
    done = 0
    while len(pairs):
        left = length[pairs + 1] - done
        drop = np.where(left < 8, 64 - 8 * np.clip(left, 1, 8), 0).astype(np.uint64)
        a, b = w[np.minimum(at[pairs] + done, len(t))], w[np.minimum(at[pairs + 1] + done, len(t))]
        alike = (a >> drop) == (b >> drop)
        same[pairs[alike & (left <= 8)]] = True
        pairs = pairs[alike & (left > 8)]
        done += 8
    return same


def _induced(t: np.ndarray, part: np.ndarray, fixed: list[np.ndarray], begin: list[np.ndarray], wanted: np.ndarray) -> list[np.ndarray]:
    """For each part the wanted suffixes in order, induced from right to left by the `fixed` ones and by each other.

    A part is a range of buckets. A suffix stands in the bucket of its first value, the wanted ones first, and there
    in the order of the suffix right of it; so what comes from earlier parts is in place, and what a part
    induces in itself is put in round by round.
    """
    arrived: list[list[np.ndarray]] = [[] for _ in fixed]
    for i in begin:
        arrived[part[i[0]]].append(i)
    place = np.zeros(len(t) + 1, np.int64)
    out = []
    for p, own in enumerate(fixed):
        came = _join(arrived[p])
        items = np.concatenate((came, own))
        bucket = 2 * t[items]
        bucket[len(came) :] += 1
        by = np.argsort(bucket, kind="stable")
        items, bucket, inside = items[by], bucket[by], np.zeros(len(items), bool)
        now = items
        while True:
            now = now[now > 0] - 1
            now = now[wanted[now] & (part[now] == p)]
            if not len(now):
                break
            place[items] = np.arange(1, len(items) + 1)
            most = len(items) + 1
            rank = 2 * t[now] * most + place[now + 1]
            by = np.argsort(rank)
            at = np.searchsorted(bucket * most + np.where(inside, place[items + 1], 0), rank[by], "right")
            at += np.arange(len(at))
            held = np.ones(len(items) + len(at), bool)
            held[at] = False
            before, items = items, np.empty(len(held), np.int64)
            items[held], items[at] = before, now[by]
            before, bucket = bucket, np.empty(len(held), np.int64)
            bucket[held], bucket[at] = before, 2 * t[now[by]]
            before, inside = inside, np.ones(len(held), bool)
            inside[held] = before
        out.append(items[(bucket & 1) == 0])
        before = items[items > 0] - 1
        before = before[wanted[before]]
        to = part[before]
        before, to = before[to > p], to[to > p]
        by = np.argsort(to, kind="stable")
        before, to = before[by], to[by]
        edges = np.flatnonzero(to[1:] != to[:-1]) + 1
        for piece in np.split(before, edges) if len(before) else ():
            arrived[part[piece[0]]].append(piece)
    return out


def _induce_values(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """_induce for values of any size, by parts of neighbouring buckets."""
    n = len(t)
    count = np.bincount(t)
    parts = int(np.clip(n // PART, 1, 128))
    part = ((np.cumsum(count) - count) * parts // n).astype(np.int16)[t]
    lms = lms[np.argsort(part[lms], kind="stable")]
    edges = np.searchsorted(part[lms], np.arange(1, parts))
    large = _induced(t, part, np.split(lms, edges), [np.array([n - 1])], ~s_type)
    small = _induced(t.max() - t, parts - 1 - part, [x[::-1] for x in large[::-1]], [], s_type)
    items = np.concatenate((*large, *[x[::-1] for x in small[::-1]]))
    return items[np.argsort(2 * t[items] + s_type[items], kind="stable")]


def _equal_values(t: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """_equal_neighbours for values of any size."""
    pairs = np.flatnonzero(length[1:] == length[:-1])
    same = np.zeros(len(at) - 1, bool)
    done = 0
    while len(pairs):
        pairs = pairs[t[np.minimum(at[pairs] + done, len(t) - 1)] == t[np.minimum(at[pairs + 1] + done, len(t) - 1)]]
        done += 1
        ends = length[pairs + 1] == done
        same[pairs[ends]] = True
        pairs = pairs[~ends]
    return same


def suffix_array(t: np.ndarray, levels: list[int] | None = None) -> np.ndarray:
    """All suffixes in lexicographic order; one that ends is less than one that goes on. `levels` gets the length of each text of the recursion."""
    n = len(t)
    if levels is not None:
        levels.append(n)
    if n < 2:
        return np.arange(n)
    induce, equal = (_induce, _equal_neighbours) if t.dtype == np.uint8 else (_induce_values, _equal_values)
    s_type = _s_type(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if not len(lms):
        return induce(t, s_type, lms)
    by_substring = induce(t, s_type, lms)
    by_substring = by_substring[is_lms[by_substring]]
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    same = equal(t, by_substring, length[by_substring])
    ends = by_substring == lms[-1]
    same &= ~(ends[1:] | ends[:-1])
    name = np.zeros(n, np.int64)
    name[by_substring] = np.concatenate(([0], np.cumsum(~same)))
    if same.any():
        by_substring = lms[suffix_array(name[lms], levels)]
    return induce(t, s_type, by_substring)


def permuted_common_prefix(t: np.ndarray, sa: np.ndarray, most: int, fences: np.ndarray) -> np.ndarray:
    """For each suffix, the values it shares with its predecessor in `sa`, counted up to `most`.

    Only irreducible positions are compared; where suffix and predecessor both move on by one from the
    position before, the count is one less. `fences` are positions to compare in any case.
    """
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    if n > 1:
        moved = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
        fresh[1:] = ~(moved & (t[:-1] == t[np.maximum(before[:-1], 0)]))
    fresh[fences] = True
    at = np.flatnonzero(fresh)
    w = _words8(t)
    count = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    done = 0
    while len(live) and done < most:
        i, j = at[live] + done, before[at[live]] + done
        within = (i < n) & (j < n)
        live, i, j = live[within], i[within], j[within]
        differ = w[i] ^ w[j]
        here = sum((differ < np.uint64(1 << bits)).astype(np.int64) for bits in range(0, 64, 8))
        here = np.minimum(here, np.minimum(n - i, n - j))
        count[live] += here
        live = live[here == 8]
        done += 8
    run = np.cumsum(fresh) - 1
    return np.maximum(count[run] - (np.arange(n) - at[run]), 0)
