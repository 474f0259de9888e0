"""Declared layouts against a reader that goes through one message at a time: every prefix, nested lists, conditions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capquill.operators import layouts as L
from capquill.operators.layouts import Bits, Layout, Number, Octets, Of, Only, Repeated

LINE = Layout({"k": Number(1), "size": Number(1), "name": Octets(Of("size"), text=True), "extra": Only(Number(2, little=True), "k", (7, 9))})
ORDER = Layout({"key": Number(3), "n": Number(1), "lines": Repeated(LINE, count=Of("n")), "pairs": Repeated(Layout({"a": Number(1), "b": Number(1, signed=True)}), count=Of("head.pairs"))})
MESSAGE = Layout({"head": Bits({"version": 4, "pairs": 4}), "span": Number(2), "orders": Repeated(ORDER, length=Of("span")), "tail": Octets(2), "rest": Octets()})


class Cut(Exception):
    pass


def plain(b):
    """The message as nested dicts, read one part after the other."""
    if b is None:
        return None
    out = dict.fromkeys(MESSAGE.parts)

    def number(at, end, n, order="big", signed=False):
        if at + n > end:
            raise Cut
        return int.from_bytes(b[at : at + n], order, signed=signed), at + n

    def line(at, end):
        x = dict.fromkeys(LINE.parts)
        x["k"], at = number(at, end, 1)
        x["size"], at = number(at, end, 1)
        if at + x["size"] > end:
            raise Cut
        x["name"], at = b[at : at + x["size"]].decode("utf-8", "replace"), at + x["size"]
        if x["k"] in (7, 9):
            x["extra"], at = number(at, end, 2, "little")
        return x, at

    def order(at, end, pairs):
        x = {"lines": [], "pairs": []}
        x["key"], at = number(at, end, 3)
        x["n"], at = number(at, end, 1)
        for _ in range(x["n"]):
            one, at = line(at, end)
            x["lines"].append(one)
        for _ in range(pairs):
            a, at = number(at, end, 1)
            c, at = number(at, end, 1, signed=True)
            x["pairs"].append({"a": a, "b": c})
        return x, at

    try:
        v, at = number(0, len(b), 1)
        out["head"] = {"version": v >> 4, "pairs": v & 15}
        out["span"], at = number(at, len(b), 2)
        if at + out["span"] > len(b):
            raise Cut
        stop, out["orders"] = at + out["span"], []
        try:
            while at < stop:
                one, at = order(at, stop, v & 15)
                out["orders"].append(one)
        except Cut:
            pass
        if stop + 2 > len(b):
            raise Cut
        out["tail"], out["rest"] = b[stop : stop + 2], b[stop + 2 :]
    except Cut:
        pass
    return out


def message(rng):
    pairs = rng.randrange(4)
    body = b""
    for _ in range(rng.randrange(5)):
        n = rng.randrange(4)
        body += rng.randbytes(3) + bytes([n])
        for _ in range(n):
            k, name = rng.choice([1, 7, 9]), rng.choice([b"", b"abc", "né".encode(), b"\xff\xfe"])
            body += bytes([k, len(name)]) + name + (rng.randbytes(2) if k != 1 else b"")
        body += rng.randbytes(2 * pairs)
    body += rng.randbytes(rng.choice([0, 0, 1, 5]))
    return bytes([0x50 | pairs]) + len(body).to_bytes(2) + body + b"T1" + rng.randbytes(rng.randrange(3))


def test_every_prefix_is_read_as_one_by_one():
    rng = random.Random(5)
    whole = [message(rng) for _ in range(60)]
    values = [None, b"", *whole, *(m[:n] for m in whole[:12] for n in range(len(m)))]
    batch = pa.array([b"before", *values], pa.binary())[1:]  # with an offset
    assert L.read(batch, MESSAGE).to_pylist() == [plain(v) for v in values]
    assert len(L.read(pa.array([], pa.binary()), MESSAGE)) == 0


def test_in_spark(spark):
    rng = random.Random(6)
    values = [None, b"", *(message(rng) for _ in range(40))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b binary")
    got = df.select("i", L.decoded(F.col("b"), MESSAGE).alias("m")).orderBy("i").collect()
    assert [r.m and r.m.asDict(True) for r in got] == [plain(v) for v in values]
    assert df.limit(0).select(L.decoded(F.col("b"), MESSAGE).alias("m")).collect() == []


def test_lists_without_end_and_sizes_below_zero():
    counted = Layout({"n": Number(4), "x": Repeated(Layout({"y": Only(Number(1), "n", (5,))}), count=Of("n")), "z": Number(1)})
    assert L.read(pa.array([b"\xff\xff\xff\xff\x01", b"\0\0\0\0\x02"]), counted).to_pylist() == [{"n": 2**32 - 1, "x": [], "z": None}, {"n": 0, "x": [], "z": 2}]
    sized = Layout({"n": Number(1), "x": Octets(Of("n", 4, -20)), "z": Number(8)})
    got = L.read(pa.array([b"\x04" + b"x" * 9, b"\x05" + b"\xff" * 8, b"\x06abcd" + b"\0" * 8]), sized).to_pylist()
    assert got == [{"n": 4, "x": None, "z": None}, {"n": 5, "x": b"", "z": -1}, {"n": 6, "x": b"abcd", "z": 0}]
    huge = Layout({"n": Number(4), "x": Repeated(Number(2), count=Of("n"))})
    assert L.read(pa.array([b"\xff\xff\xff\xff\0\x01\0\x02\x03"]), huge).to_pylist() == [{"n": 2**32 - 1, "x": [1, 2]}]


@pytest.mark.parametrize("parts", [{"a": Octets(Of("n"))}, {"a": Repeated(Number(1), count=Of("n")), "n": Number(1)}, {"a": Only(Number(1), "b", (1,))}])
def test_names_must_stand_before(parts):
    with pytest.raises(ValueError):
        L.decoded(F.lit(b""), Layout(parts))
