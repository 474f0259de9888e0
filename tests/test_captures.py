"""Capture files out and in again, by each format, and files that are cut off."""

import gzip
import struct

import pytest

from capquill.operators import dissect as D
from capquill.operators import flows, layers, reassembly
from capquill.sources import captures

ROWS = [(0, 1_700_000_000_999_999_999, 60, b"\x01" * 60), (1, 1_700_000_001_000_000_001, 1500, b"abc"), (2, 0, 0, b""), (3, 5_000_000_123, 7, b"1234567")]


@pytest.mark.parametrize("kind,unit", [("pcap", 1000), ("pcap_ns", 1), ("pcapng", 1), ("erf", 1)])
def test_round_trip(spark, tmp_path, kind, unit):
    df = spark.createDataFrame(ROWS, "num bigint, ts_ns bigint, wirelen bigint, data binary").coalesce(1)
    assert [r.packets for r in captures.write(df, str(tmp_path), kind=kind).collect()] == [4]
    got = captures.read(spark, str(tmp_path)).orderBy("num").collect()
    assert [(r.num, r.ts_ns // unit, r.wirelen, bytes(r.data)) for r in got] == [(n, t // unit, w, d) for n, t, w, d in ROWS]
    (path,) = tmp_path.glob(f"*.{kind.removesuffix('_ns')}")
    captures.write(df, f"file://{tmp_path}/zipped", kind=kind, compressed=True).collect()
    (zipped,) = (tmp_path / "zipped").glob("*.gz")
    assert gzip.decompress(zipped.read_bytes()) == path.read_bytes()
    raw = path.read_bytes()
    for cut in (0, 3, 10, 25, len(raw) // 2, len(raw) - 1):  # never fails, and gives the packets before the cut
        kept = list(captures.records(raw[:cut]))
        assert [k[4] for k in kept] == [r[3] for r in ROWS[: len(kept)]] and len(kept) < 4
    assert [k[4] for k in captures.records(gzip.compress(raw))] == [r[3] for r in ROWS]


def test_erf_extension_headers():
    body = struct.pack("<II", 0, 9) + struct.pack(">BBHHH", 0x82, 4, 16 + 16 + 2 + 3, 0, 3) + b"\x80" + bytes(7) + bytes(8) + bytes(2) + b"xyz"
    assert [r[4] for r in captures.records(body)] == [b"xyz"]


def frame(proto, transport, src="0a000001", dst="0a000002"):
    return bytes.fromhex("ffffffffffff0200000000010800" + "4500") + (20 + len(transport)).to_bytes(2) + bytes(4) + bytes([64, proto]) + bytes(2) + bytes.fromhex(src + dst) + transport


def test_frames_that_are_cut_off_or_null(spark):
    whole = frame(6, bytes.fromhex("1234005000000001000000005002200000000000") + b"hello")
    rows = [(i, whole[:i]) for i in range(len(whole) + 1)] + [(900, None)]
    d = D.dissect(D.capture(spark.createDataFrame(rows, "num bigint, data binary")), fields=["TCP.sport"])
    got = {r.num: r for r in d.select("num", "chain", D.layer_column("TCP.sport", decoded=True).alias("sport"), D.layer_column("IP.src").alias("src"), D.ip_checksum().alias("sum")).collect()}
    assert len(got) == len(rows) and got[900].chain == [] and got[900].src is None
    for n, r in got.items():
        if n < 900:
            assert (r.src is not None) == (n >= 34) == (r["sum"] is not None) and (r.sport is not None) == (n >= 54), n


def test_keys_and_captures_apart(spark):
    unreachable = frame(1, bytes.fromhex("0301000000000000") + bytes(28))
    echo = frame(1, bytes.fromhex("0800000000070001"))
    rows = [(c, n, x) for c in ("a", "b") for n, x in enumerate((unreachable, echo))]
    df = D.capture(spark.createDataFrame(rows, "capture string, num bigint, data binary"))
    got = {(r.capture, r.session): r.packets for r in flows.sessions(df).collect()}
    keys = ("ICMP 10.0.0.1 > 10.0.0.2 type=3 code=1", "ICMP 10.0.0.1 > 10.0.0.2 type=8 code=0 id=0x7")
    assert got == {(c, k): 1 for c in "ab" for k in keys}


def test_a_user_layer(spark):
    tag = layers.user_layer("Tag", {"kind": layers.Field(0, 8), "id": layers.Field(8, 24)})
    df = D.capture(spark.createDataFrame([(1, frame(17, bytes.fromhex("1000270f000d0000") + b"\x07\x00\x01\x02z")), (2, frame(17, bytes.fromhex("1000270e000d0000") + b"12345"))], "num bigint, data binary"))
    d = D.dissect(df, bind=[(tag, "UDP", {"dport": 9999})])
    got = {r.num: r for r in d.select("num", "chain", tag.value("kind").alias("kind"), tag.value("id").alias("id")).collect()}
    assert (got[1].kind, got[1].id, got[1].chain[-1]) == (7, 258, "Tag") and got[2].kind is None and got[2].chain[-1] == "Raw"
    with pytest.raises(ValueError):
        layers.user_layer("Odd", {"x": layers.Field(0, 7)})


def test_first_writer_against_a_map():
    import random

    r = random.Random(5)
    for _ in range(300):
        pieces = [(r.randrange(60), bytes(r.randrange(256) for _ in range(r.randrange(12)))) for _ in range(r.randrange(14))]
        held = {}
        for at, o in pieces:
            for i, x in enumerate(o):
                held.setdefault(at + i, x)
        got = {}
        for at, o in reassembly.first_writer(pieces):
            for i, x in enumerate(o):
                assert at + i not in got
                got[at + i] = x
        assert got == held


def test_truncated_lists(spark):
    from pyspark.sql import functions as F

    from capquill.operators import records

    message = bytes.fromhex("0001818000010001000000000161c00c00010001c00c000100010000003c000401020304")  # the name points into itself
    good = bytes.fromhex("000181800001000100000000016100" + "00010001" + "c00c000100010000003c000401020304")
    df = spark.createDataFrame([(0, None), (1, b""), (2, message), (3, good), (4, good[:-1])], "n int, data binary")
    got = {r.n: r.items for r in df.select("n", records.dns_records(F.col("data")).alias("items")).collect()}
    assert got[0] is None and got[1] == [] and got[2] == [] and [(x.section, x.name, x.data) for x in got[3]] == [("qd", "a.", None), ("an", "a.", "1.2.3.4")] and len(got[4]) == 1
    walked = {r.n: r for r in df.select("n", records.tlv(F.col("data")).alias("t"), records.ber_values(F.col("data")).alias("b")).collect()}
    assert walked[0].t is None and walked[0].b is None and walked[1].t == walked[1].b == []
