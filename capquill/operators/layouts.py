"""Layouts of variable size that a user declares: octets are read to nested columns, a whole batch at a time.

A layout is named parts in order. How long a part is, how often it repeats and whether it is there at all may depend
on parts before it, of the layouts around it too; inner names hide outer ones. Every part is read for all rows of a
batch by numpy, with a cursor for each row. Lists of elements of one size are read at once, other lists one element a
step, for all rows together.

What is defined: null octets give null. A part that isn't wholly there is null, and so is all that comes after it in the
row, up to the end of the innermost list with a length in octets. A list that is cut off holds its whole elements. An
element of no octets ends its list. A size that is null or negative counts as cut off.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


@dataclass(frozen=True)
class Of:
    """A size told by an earlier number: name * times + plus."""

    name: str
    times: int = 1
    plus: int = 0


@dataclass(frozen=True)
class Rows:
    """Where reading stands in the rows of a batch."""

    octets: np.ndarray
    at: np.ndarray
    end: np.ndarray
    good: np.ndarray
    seen: dict[str, tuple[np.ndarray, np.ndarray]]

    def take(self, rows: np.ndarray, at: np.ndarray) -> Rows:
        """Some rows (or rows several times) at other places, all of them good."""
        seen = {n: (v[rows], there[rows]) for n, (v, there) in self.seen.items()}
        return Rows(self.octets, at, self.end[rows], np.ones(len(rows), bool), seen)

    def size(self, of: Of | int | None) -> tuple[np.ndarray, np.ndarray]:
        """A size in each row, and where there is one; None: up to the end."""
        if of is None:
            return self.end - self.at, self.good
        if isinstance(of, int):
            return np.full(len(self.at), of, np.int64), self.good
        value, there = self.seen[of.name]
        size = value * of.times + of.plus
        return size, self.good & there & (size >= 0)

    def span(self, of: Of | int | None) -> tuple[np.ndarray, np.ndarray]:
        """The octets of a part, 0 where it isn't wholly there, and where it is."""
        size, there = self.size(of)
        there = there & (size <= self.end - self.at)
        return np.where(there, size, 0), there

    def after(self, size: np.ndarray, there: np.ndarray) -> Rows:
        return replace(self, at=self.at + size, good=there)


@dataclass(frozen=True)
class Number:
    """An integer of 1 to 8 octets; of 8 it is signed in any case."""

    octets: int
    signed: bool = False
    little: bool = False
    ddl = "bigint"

    def __post_init__(self):
        if not 1 <= self.octets <= 8:
            raise ValueError(f"a number of {self.octets} octets")

    def width(self) -> int | None:
        return self.octets

    def value(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        _, there = r.span(self.octets)
        at, out = np.where(there, r.at, 0), np.zeros(len(r.at), np.uint64)
        if there.any():
            for k in range(self.octets)[:: -1 if self.little else 1]:
                out = out << np.uint64(8) | r.octets[np.where(there, at + k, 0)]
        out = out.astype(np.int64)
        if self.signed and self.octets < 8:
            half = 1 << (8 * self.octets - 1)
            out = (out ^ half) - half
        return out, there

    def read(self, r: Rows) -> tuple[pa.Array, Rows]:
        value, there = self.value(r)
        return pa.array(value, mask=~there), r.after(np.where(there, self.octets, 0), there)


@dataclass(frozen=True)
class Bits:
    """Numbers within octets, from the most significant bit on; their widths add up to 1 to 7 octets."""

    widths: dict[str, int] = field(hash=False)

    def __post_init__(self):
        total = sum(self.widths.values())
        if total % 8 or not 8 <= total <= 56:
            raise ValueError(f"widths add up to {total} bits")

    @property
    def ddl(self) -> str:
        return "struct<" + ",".join(f"`{n}`:bigint" for n in self.widths) + ">"

    def width(self) -> int | None:
        return sum(self.widths.values()) // 8

    def parts(self, r: Rows) -> tuple[dict[str, np.ndarray], np.ndarray]:
        value, there = Number(self.width()).value(r)
        out, left = {}, 8 * self.width()
        for name, width in self.widths.items():
            left -= width
            out[name] = value >> left & ((1 << width) - 1)
        return out, there

    def read(self, r: Rows) -> tuple[pa.Array, Rows]:
        parts, there = self.parts(r)
        made = pa.StructArray.from_arrays([pa.array(v) for v in parts.values()], list(parts), mask=pa.array(~there))
        return made, r.after(np.where(there, self.width(), 0), there)


@dataclass(frozen=True)
class Octets:
    """Octets of a size, None: up to the end; as text they are UTF-8, and what is wrong in it is replaced."""

    size: Of | int | None = None
    text: bool = False

    @property
    def ddl(self) -> str:
        return "string" if self.text else "binary"

    def width(self) -> int | None:
        return self.size if isinstance(self.size, int) else None

    def read(self, r: Rows) -> tuple[pa.Array, Rows]:
        size, there = r.span(self.size)
        ends = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(ends[-1]) + np.repeat(r.at - ends[:-1], size)
        body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(r.octets[places].tobytes())])
        body = pa.compute.if_else(pa.array(there), body, pa.scalar(None, pa.large_binary()))
        if self.text:
            body = pa.array([None if b is None else b.decode("utf-8", "replace") for b in body.to_pylist()], pa.string())
        return body, r.after(size, there)


@dataclass(frozen=True)
class Only:
    """A part that is there only where an earlier number is one of some values."""

    part: object
    name: str
    values: tuple[int, ...]

    @property
    def ddl(self) -> str:
        return self.part.ddl

    def width(self) -> int | None:
        return None

    def read(self, r: Rows) -> tuple[pa.Array, Rows]:
        value, there = r.seen[self.name]
        wanted = there & np.isin(value, self.values)
        made, then = self.part.read(replace(r, good=r.good & wanted))
        return made, replace(r, at=np.where(wanted, then.at, r.at), good=np.where(wanted, then.good, r.good))


@dataclass(frozen=True)
class Layout:
    """Named parts, one after the other."""

    parts: dict[str, object] = field(hash=False)

    @property
    def ddl(self) -> str:
        return "struct<" + ",".join(f"`{n}`:{p.ddl}" for n, p in self.parts.items()) + ">"

    def width(self) -> int | None:
        widths = [p.width() for p in self.parts.values()]
        return None if None in widths else sum(widths)

    def read(self, r: Rows) -> tuple[pa.Array, Rows]:
        begun, outer, made = r.good, r.seen, []
        for name, part in self.parts.items():
            own = {}
            if isinstance(part, Bits):
                values, there = part.parts(r)
                own = {f"{name}.{n}": (v, there) for n, v in values.items()}
            inner = part.part if isinstance(part, Only) else part
            column, then = part.read(r)
            if isinstance(inner, Number):
                own = {name: (column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False))}
            made.append(column)
            r = replace(then, seen={**r.seen, **own})
        return pa.StructArray.from_arrays(made, list(self.parts), mask=pa.array(~begun)), replace(r, seen=outer)


@dataclass(frozen=True)
class Repeated:
    """A list: of a count of elements, or of what lies within a length in octets, or else up to the end."""

    part: object
    count: Of | int | None = None
    length: Of | int | None = None

    @property
    def ddl(self) -> str:
        return f"array<{self.part.ddl}>"

    def width(self) -> int | None:
        return None

    def read(self, r: Rows) -> tuple[pa.Array, Rows]:
        if self.count is not None:
            left, there = r.size(self.count)
            inside = r
        else:
            size, there = r.span(self.length)
            inside, left = replace(r, end=r.at + size), np.full(len(r.at), np.iinfo(np.int64).max)
        begin = replace(inside, good=there)
        rows, made, at, whole = self._same(begin, left) if self.part.width() else self._stepwise(begin, left)
        counts = np.bincount(rows, minlength=len(r.at))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        made = pa.ListArray.from_arrays(offsets, made, mask=pa.array(~there))
        if self.count is None:  # what lies behind a length is known, whatever was in it
            return made, r.after(size, there)
        return made, replace(r, at=at, good=there & whole)

    def _same(self, r: Rows, left: np.ndarray):
        """All elements at once, as each is as long as any other."""
        width = self.part.width()
        n = np.where(r.good, np.minimum(left, (r.end - r.at) // width), 0)
        rows = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        made, _ = self.part.read(r.take(rows, r.at[rows] + nth * width))
        return rows, made, r.at + n * width, n == left

    def _stepwise(self, r: Rows, left: np.ndarray):
        """The next element of every row that has one, then those after them."""
        at, left, whole = r.at.copy(), left.copy(), np.ones(len(r.at), bool)
        more = lambda rows: rows[(left[rows] > 0) & ((self.count is not None) | (at[rows] < r.end[rows]))]
        rows, parts, of = more(np.flatnonzero(r.good)), [], []
        while len(rows):
            column, then = self.part.read(r.take(rows, at[rows]))
            done = then.good & (then.at > at[rows])
            whole[rows[~done]] = False
            parts.append(column.filter(pa.array(done)))
            rows = rows[done]
            at[rows] = then.at[done]
            left[rows] -= 1
            of.append(rows)
            rows = more(rows)
        if not parts:
            empty, _ = self.part.read(r.take(np.zeros(0, np.int64), np.zeros(0, np.int64)))
            return np.zeros(0, np.int64), empty, at, whole
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return of[order], pa.concat_arrays(parts).take(pa.array(order)), at, whole


def _names(part: object, known: frozenset[str] = frozenset()) -> frozenset[str]:
    """The names that a part adds; ValueError where a size or a condition names none that stands before it."""
    sizes = [getattr(part, a, None) for a in ("size", "count", "length")]
    for name in [s.name for s in sizes if isinstance(s, Of)] + ([part.name] if isinstance(part, Only) else []):
        if name not in known:
            raise ValueError(f"no number {name} before it")
    if isinstance(part, Layout):
        inner = known
        for name, p in part.parts.items():
            _names(p, inner)
            bare = p.part if isinstance(p, Only) else p
            inner = inner | ({name} if isinstance(bare, Number) else {f"{name}.{n}" for n in p.widths} if isinstance(p, Bits) else set())
    elif isinstance(part, (Only, Repeated)):
        _names(part.part, known)
    return known


def read(values: pa.Array, layout: Layout) -> pa.Array:
    """The values of a batch as the layout says."""
    values = values.cast(pa.large_binary())
    there = values.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, body = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    octets = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return layout.read(Rows(octets, offsets[:-1].copy(), offsets[1:].copy(), there, {}))[0]


def decoded(data: Column, layout: Layout) -> Column:
    """Octets as nested columns; the layout is checked first."""
    from pyspark.sql.pandas.types import to_arrow_type

    _names(layout)
    kind = DataType.fromDDL(layout.ddl)
    arrow = to_arrow_type(kind)

    def run(values: pa.Array) -> pa.Array:
        return read(values, layout).cast(arrow)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(data)
