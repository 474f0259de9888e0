"""Sequence lines, streams and pairs: what a capture may hold and the tables' fixtures do not."""

import random

import pytest
from pyspark.sql import functions as F

from capquill.operators import dissect as D
from capquill.operators import flows, pairing, reassembly
from tests.test_stack import MACS, ip, udp


def six(a, b, proto, body):
    return MACS + bytes.fromhex("86dd60000000") + len(body).to_bytes(2) + bytes([proto, 64]) + bytes(15) + bytes([a]) + bytes(15) + bytes([b]) + body


def segment(sport, dport, seq=0, flags=16, body=b""):
    return sport.to_bytes(2) + dport.to_bytes(2) + (seq % 2**32).to_bytes(4) + bytes(4) + bytes([0x50, flags]) + bytes(6) + body


def capture(spark, frames):
    return D.capture(spark.createDataFrame(list(enumerate(frames)), "num bigint, data binary"))


def pairs(df):
    return sorted((r.num, r.answer) for r in df.collect())


def test_strangers_do_not_answer(spark):
    df = capture(spark, [six(1, 2, 6, segment(1000, 80)), six(3, 4, 6, segment(80, 1000)), six(2, 1, 6, segment(80, 1000)), six(1, 2, 17, udp(5, 6, b"")), six(2, 1, 17, udp(6, 5, b""))])
    assert pairs(pairing.answers(df)) == pairs(pairing.pairs(df)) == pairs(pairing.pairs(df, F.col("num").isin(0, 3))) == [(0, 2), (3, 4)]


def test_no_side_of_answers_is_broadcast(spark, tmp_path):
    capture(spark, [six(1, 2, 6, segment(1, 2)), six(2, 1, 6, segment(2, 1))]).write.parquet(f"{tmp_path}/frames")
    df = spark.read.parquet(f"{tmp_path}/frames")
    for lookahead in (None, 3):
        met = pairing.answers(df, lookahead)
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString() and pairs(met) == [(0, 1)]


def test_a_used_packet_asks_no_more(spark):
    there, back = six(1, 2, 6, segment(1, 2)), six(2, 1, 6, segment(2, 1))
    assert pairs(pairing.pairs(capture(spark, [there, back, there, back]))) == [(0, 1), (2, 3)]
    assert pairs(pairing.pairs(capture(spark, [back, there, there, there, back]))) == [(0, 1), (2, 4)]
    assert pairs(pairing.paired_once(capture(spark, [there, there, there, back]), lookahead=2)) == [(1, 3)]
    r = random.Random(4)
    way = [r.random() < 0.5 for _ in range(300)]
    want, left = [], list(range(300))
    while left:  # the list's own loop: each takes the first later answer, and both go
        s = left.pop(0)
        if found := next((x for x in left if way[x] != way[s]), None):
            want.append((s, found))
            left.remove(found)
    assert pairs(pairing.pairs(capture(spark, [there if w else back for w in way]))) == sorted(want)


def test_icmp_v6_and_dns(spark):
    echo = lambda kind, n: bytes([kind, 0, 0, 0, 0, 7, 0, n])
    seek = lambda kind, n: bytes([kind, 0, 0, 0, 0, 0, 0, 0]) + bytes(15) + bytes([n])
    dns = lambda n, qr: n.to_bytes(2) + bytes([qr * 128]) + bytes(9)
    frames = [
        six(1, 2, 58, echo(128, 1)), six(1, 2, 58, echo(128, 2)), six(2, 1, 58, echo(129, 2)), six(2, 1, 58, echo(129, 1)), six(1, 9, 58, seek(135, 5)), six(5, 1, 58, seek(136, 5)), six(6, 1, 58, seek(136, 6)),
        MACS + b"\x08\x00" + ip(17, udp(4000, 53, dns(7, 0))), MACS + b"\x08\x00" + ip(17, udp(53, 4000, dns(8, 1)), "0a000002", "0a000001"), MACS + b"\x08\x00" + ip(17, udp(53, 4000, dns(7, 1)), "0a000002", "0a000001"),
        MACS + b"\x08\x00" + ip(1, bytes([13, 0, 0, 0, 0, 1, 0, 1]) + bytes(12)), MACS + b"\x08\x00" + ip(1, bytes([0, 0, 0, 0, 0, 1, 0, 1]) + bytes(12), "0a000002", "0a000001"), MACS + b"\x08\x00" + ip(1, bytes([14, 0, 0, 0, 0, 1, 0, 1]) + bytes(12), "0a000002", "0a000001"),
    ]
    want = [(0, 3), (1, 2), (4, 5), (7, 9), (10, 12)]
    df = capture(spark, frames)
    assert pairs(pairing.pairs(df)) == pairs(pairing.answers(df)) == pairs(pairing.answers(df, lookahead=4)) == want


def test_offsets_beyond_32_bits(spark):
    seqs = [0, 2**30, 2**31 + 4, 2**31 + 4, 2**31 + 2**30, 2**32 + 9, 2**32, 2**33, 3 * 2**32, 5, 4 * 2**32]
    # 5 follows 3 * 2**32, as a number that comes again far later is nearer to where the stream is then
    line = [0, 2**30, 2**31 + 4, 2**31 + 4, 2**31 + 2**30, 2**32 + 9, 2**32]
    steps = [0, 2**31 - 1, -(2**31 - 5), 10, 2**31 - 1, 2**31 - 1, 2**31 - 1, 2**31 - 1, -7, 2**31 - 1, 2**31 - 1]
    for start in (0, 4_000_000_000):
        for block in (1, 2, 3, 1000):
            at, want, frames = 0, [], []
            for s in steps:
                at += s
                want.append(at)
                frames.append(MACS + b"\x08\x00" + ip(6, segment(1, 2, start + at, 16, b"abcd")))
            df = capture(spark, frames)
            got = {r.num: r.rel for r in reassembly.tcp_segments(df, block).collect()}
            assert [got[i] for i in range(len(steps))] == want
    (r,) = reassembly.streams(df).collect()
    held = {a + i for a in want for i in range(4)}
    assert (r.segments, r.octets, r.missing, r.dropped) == (len(steps), len({x for x in held if x >= 0}), max(held) + 1 - len({x for x in held if x >= 0}), 0)
    got = sorted((p["at"], bytes(p["octets"])) for p in reassembly.stream_pieces(df).collect())
    assert sum(len(o) for _, o in got) == r.octets and max(a for a, _ in got) > 2**33
    df = capture(spark, [MACS + b"\x08\x00" + ip(6, segment(1, 2, s, 16, b"ab")) for s in seqs[:7]])
    assert sorted(x.rel for x in reassembly.tcp_segments(df, 2).collect()) == sorted(line)


def test_streams_against_a_map(spark):
    r = random.Random(9)
    frames, held, counted = [MACS + b"\x08\x00" + ip(6, segment(7, 80, 2**32 - 51, 2))], set(), 1
    dropped = 0
    for _ in range(400):
        at, n = r.randrange(-20, 3000), r.randrange(0, 40)
        frames.append(MACS + b"\x08\x00" + ip(6, segment(7, 80, 2**32 - 50 + at, 16 | (r.random() < 0.1), bytes(n))))
        held |= set(range(max(0, at), at + n))
        dropped += max(0, min(0, at + n) - min(0, at))
        counted += 1
    for block in (16, 700, 1 << 20):
        (s,) = reassembly.streams(capture(spark, frames), block).collect()
        assert (s.segments, s.octets, s.missing, s.dropped) == (counted, len(held), max(held) + 1 - len(held), dropped) and s.syn and s.fin and not s.rst


def test_relative_sequence_in_blocks(spark):
    r = random.Random(2)
    rows, at = [], {0: 5, 1: 4_000_000_000}
    start = dict(at)
    for num in range(500):
        k = r.randrange(2)
        rows.append((num, k, at[k] % 2**32, at[k] - start[k]))
        at[k] += r.randrange(-1000, 2**31 - 1)
    df = spark.createDataFrame(rows, "num bigint, k int, seq bigint, want bigint")
    for block in (7, 1 << 20):
        assert flows.relative_sequence(df, ["k"], block=block).where("rel <> want").count() == 0


def tcp_frames(pieces, start=100):
    return [MACS + b"\x08\x00" + ip(6, segment(80, 9, start + at, 16, body)) for at, body in pieces]


def test_a_splice_repeats_no_octet(spark):
    one, two = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nvwxyz"
    stream = one + two + b"HTTP/1.1 200"
    cuts = [0, len(one) + 7, len(one) + len(two) - 2, len(stream)]
    df = capture(spark, tcp_frames([(a, stream[a:b]) for a, b in zip(cuts, cuts[1:])]))
    for block in (16, 1 << 20):
        got = sorted((r.num, r.at, r.kind, bytes(r.octets)) for r in reassembly.spliced(df, reassembly.http_messages(df), block).collect())
        assert got == [(0, 0, "message", b"abc"), (2, len(one), "message", b"vwxyz"), (2, len(one + two), "segment", b"HTTP/1.1 200")]
    inner = b"--" + one  # no message: all stays
    df = capture(spark, tcp_frames([(0, inner[:9]), (9, inner[9:])]))
    none = reassembly.http_messages(df).where("false")
    assert sorted(bytes(r.octets) for r in reassembly.spliced(df, none).collect()) == sorted([inner[:9], inner[9:]])
    message = none.sparkSession.createDataFrame([(df_stream(df), 0, 2, 3, b"M")], "stream string, direction int, at bigint, length bigint, body binary")
    got = sorted((r.num, r.at, bytes(r.octets)) for r in reassembly.spliced(df, message).collect())
    assert got == [(0, 0, inner[:2]), (0, 2, b"M"), (0, 5, inner[5:9]), (1, 9, inner[9:])]


def df_stream(df):
    return reassembly.tcp_segments(df).first().stream


def test_heads_of_any_line_end_and_answers_without_a_body(spark):
    parts = [
        b"HTTP/1.1 304 Not Modified\r\nContent-Length: 500\r\n\r\n", b"HTTP/1.1 100 Continue\r\n\r\n", b"HTTP/1.1 204 No Content\n\n", b"HTTP/1.1 200 OK\nContent-Length:\n  4\n\nbody",
        b"HTTP/1.1 200 OK\r\nX: a\r\n\tb\r\nContent-Length: 2\r\n\r\nhi",
    ]
    raw = b"".join(parts)
    for size in (1, 7, 1000):
        df = capture(spark, tcp_frames([(i, raw[i : i + size]) for i in range(0, len(raw), size)]))
        got = sorted((r.at, r.length, bytes(r.body)) for r in reassembly.http_messages(df).collect())
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        assert got == [(a, len(p), b) for a, p, b in zip(starts, parts, (b"", b"", b"", b"body", b"hi"))]


def test_options_that_are_copied(spark):
    options = bytes([7, 7, 4, 0, 0, 0, 0, 1, 0x83, 7, 4, 9, 9, 9, 9, 0])  # record route, NOP, loose source route
    body = bytes(range(256)) * 8
    head = bytes([0x40 | 9, 0]) + (36 + len(body)).to_bytes(2) + bytes([0, 5, 0, 0, 64, 17, 0, 0]) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + options
    df = capture(spark, [MACS + b"\x08\x00" + head + body])
    rows = sorted(reassembly.fragment(df, 800).collect())
    pieces = [bytes(r.data)[14:] for r in rows]
    assert [p[0] & 15 for p in pieces] == [9, 7, 7] and pieces[0][20:36] == options
    assert all(p[20:28] == options[8:15] + b"\0" for p in pieces[1:]) and all(len(p) == int.from_bytes(p[2:4], "big") for p in pieces)
    assert b"".join(p[4 * (p[0] & 15) :] for p in pieces) == body
    parts = D.capture(spark.createDataFrame([(i, bytes(r.data)) for i, r in enumerate(rows)], "num bigint, data binary"))
    (whole,) = reassembly.defragment(parts).collect()
    assert whole.kind == "complete" and bytes(whole.data)[50:] == body and bytes(whole.data)[34:50] == options


def test_an_old_head_meets_no_new_tail(spark):
    def piece(at, more, body):
        return MACS + b"\x08\x00" + b"\x45\x00" + (20 + len(body)).to_bytes(2) + b"\x00\x07" + (at // 8 | more << 13).to_bytes(2) + bytes([64, 17, 0, 0]) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + body

    rows = [(0, 0.0, piece(0, 1, b"o" * 8)), (1, 100.0, piece(8, 0, b"n" * 8)), (2, 101.0, piece(0, 1, b"n" * 8)), (3, 300.0, piece(0, 1, b"x" * 8))]
    df = D.capture(spark.createDataFrame(rows, "num bigint, time double, data binary"))
    got = sorted((r.num, r.kind, bytes(r.data)[34:]) for r in reassembly.defragment(df).collect())
    assert got == [(0, "incomplete", b"o" * 8), (1, "complete", b"n" * 16), (3, "incomplete", b"x" * 8)]
    assert {r.kind for r in reassembly.defragment(df, age=None).where("num < 2").collect()} == {"complete"}


def test_lists_are_whole(spark):
    from capquill.operators import records

    n = 600
    message = bytes.fromhex("000181800000") + n.to_bytes(2) + bytes(4) + b"".join(b"\x01a\x00" + bytes.fromhex("00010001000000010004") + i.to_bytes(4) for i in range(n))
    text = "GET / HTTP/1.1\r\n" + "".join(f"H{i}: {i}\r\n" for i in range(700)) + "\r\nbody"
    (r,) = spark.createDataFrame([(message, bytes([2, 1, 5]) * 900, text.encode())], "m binary, b binary, h binary").select(
        F.size(records.dns_records(F.col("m"))).alias("dns"), F.size(records.ber_values(F.col("b"))).alias("ber"), F.size(records.header_lines(F.col("h"))).alias("lines"), F.size(records.tlv(F.col("b"))).alias("tlv")
    ).collect()
    assert (r.dns, r.ber, r.lines, r.tlv) == (600, 900, 701, 900)


def test_unknown_directives_are_text(spark):
    d = D.dissect(capture(spark, [MACS + b"\x08\x00" + ip(6, segment(1, 2))]))
    assert d.select(D.sprintf("%IP.nothing% %Nope.x% %IP.ttl%").alias("x")).first().x == "%IP.nothing% %Nope.x% 64"


@pytest.mark.parametrize("delay", [1, 3, 40])
def test_lags_over_blocks(spark, delay):
    """Differences over the seams of blocks, with blocks of fewer packets than the delay, and null values."""
    rng = random.Random(delay)
    rows = [(c, n, None if rng.random() < 0.1 else rng.randrange(100)) for c in ("a", "b", None) for n in sorted(rng.sample(range(1000), 90))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "capture string, num bigint, x bigint")
    want = []
    for c in ("a", "b", None):
        one = [r for r in rows if r[0] == c]
        want += [(a[1], b[2] - a[2]) for a, b in zip(one, one[delay:]) if a[2] is not None and b[2] is not None]
    got = flows.lagged(df, F.col("x"), delay, block=16).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert flows.lagged(df.limit(0), F.col("x"), delay).count() == 0
