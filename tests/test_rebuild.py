"""Packets with new fields and payloads: every length and checksum around them, by octets written out here."""

from pyspark.sql import functions as F

from capquill.operators import dissect as D
from capquill.operators import rebuild, templates
from capquill.plans.queries import QUERIES
from tests.test_stack import FRAMES, MACS, ip, tcp, udp
from tests.test_streams import capture, six


def folded(b):
    b = b + b"\0" * (len(b) % 2)
    total = sum(int.from_bytes(b[i : i + 2]) for i in range(0, len(b), 2))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


def sound(frame, at, proto, size):
    """A datagram at an offset of a frame: its header sums to nothing, and so does the transport with its pseudo header."""
    d = frame[at : at + size]
    assert int.from_bytes(d[2:4]) == size and folded(d[:20]) == 0xFFFF
    return proto is None or folded(d[12:20] + bytes([0, proto]) + (size - 20).to_bytes(2) + d[20:]) == 0xFFFF


def made(df, *args, **kw):
    return {r.num: (bytes(r.data) if r.data is not None else None, r.wirelen) for r in rebuild.rebuild(df, *args, **kw).collect()}


def test_tunnels_within_tunnels(spark):
    inner = MACS + b"\x08\x00" + ip(6, tcp(b"old"))
    middle = MACS + b"\x08\x00" + ip(17, udp(1, 4789, bytes(8) + inner))
    outer = MACS + b"\x08\x00" + ip(47, bytes.fromhex("80006558" + "00000000") + middle) + b"padding"
    new = b"a payload of another size"
    (data, wirelen) = made(capture(spark, [outer]), payload=F.lit(new))[0]
    grown = len(new) - 3
    assert data.endswith(new) and len(data) == wirelen == len(outer) - 7 + grown
    at = 14
    assert sound(data, at, None, len(data) - at) and folded(data[34:]) == 0xFFFF  # GRE has a checksum
    at = 34 + 8 + 14
    assert sound(data, at, 17, len(data) - at) and int.from_bytes(data[at + 24 : at + 26]) == len(data) - at - 20
    at += 28 + 8 + 14
    assert sound(data, at, 6, len(data) - at)


def test_pins_fragments_and_clipped_frames(spark):
    frames = [MACS + b"\x08\x00" + ip(17, udp(5, 6, b"abc")), MACS + b"\x08\x00" + ip(6, tcp(b"xyz")), six(1, 2, 17, udp(5, 6, b"ab")), None, b"", MACS + b"\x12\x34raw"]
    part = bytearray(frames[0])
    part[20] = 0x20  # more fragments
    df = capture(spark, [*frames, bytes(part)])
    got = made(df, {"IP.ttl": F.lit(9), "UDP.dport": F.when(F.col("num") == 0, 77)}, pinned=["TCP.chksum"])
    assert got[3] == (None, None) and got[4][0] == b"" and got[5][0] == frames[5]
    assert got[0][0][22] == got[1][0][22] == 9 and sound(got[0][0], 14, 17, 31) and got[0][0][36:38] == (77).to_bytes(2)
    assert got[1][0][50:52] == bytes(2) and sound(got[1][0], 14, None, 43)
    assert folded(got[2][0][22:54] + bytes([0, 17, 0, 10]) + got[2][0][54:]) == 0xFFFF
    assert got[6][0][34:] == bytes(part)[34:] and sound(got[6][0], 14, None, 31)  # a fragment's UDP sum can't be known
    cut = D.capture(spark.createDataFrame([(0, frames[1][:-2], len(frames[1]))], "num bigint, data binary, wirelen bigint"))
    assert made(cut)[0][0][50:52] == bytes(2) and made(cut)[0][1] == len(frames[1])
    whole = made(cut, payload=F.lit(b"new"))[0][0]
    assert sound(whole, 14, 6, 43) and whole.endswith(b"new")


def test_every_prefix_of_every_stack(spark):
    cut = [f[:n] for f in FRAMES.values() for n in range(len(f) + 1)]
    got = made(capture(spark, cut), {"IP.id": F.lit(3), "MPLS:2.ttl": F.lit(1)}, payload=F.when(F.col("num") % 2 == 0, F.lit(b"zz")))
    assert len(got) == len(cut) and all(d.endswith(b"zz") for n, (d, _) in got.items() if n % 2 == 0)
    assert all(len(d) == len(cut[n]) for n, (d, _) in got.items() if n % 2)


def test_drawn_octets_are_compiled(spark):
    """Draws of up to a block and their flips need no lambda, which Spark interprets for each octet; the octets are those of longer draws."""
    plan = QUERIES["random_templates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan
    d = spark.range(50).select(*[templates.random_octets(7, n, "id").alias(f"n{n}") for n in (0, 5, 32, 70)])
    assert all(r.n70[:32] == r.n32 and r.n32[:5] == r.n5 and r.n0 == b"" for r in d.collect())


def test_only_what_is_read_is_dissected(spark, monkeypatch):
    calls, real = [], D.dissect
    monkeypatch.setattr(D, "dissect", lambda df, *a, **k: calls.append(k) or real(df, *a, **k))
    QUERIES["payload_replaced"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2 and all(k.get("slim") for k in calls)
