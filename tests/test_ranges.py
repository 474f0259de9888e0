"""Capture files that many tasks read: the rows of one task, whatever the ranges' guesses."""

import gzip
import random
import struct

import pytest

from capquill.sources import captures, ranges

R = random.Random(8)


def pcap(packets, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)
    return out + b"".join(struct.pack(order + "4I", 1_700_000_000 + i, i, len(p), len(p) + i % 2) + p for i, p in enumerate(packets))


def block(kind, body, order="<"):
    size = 12 + len(body)
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def section(order, links):
    head = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    return head + b"".join(block(1, struct.pack(order + "HHI", k, 0, 0), order) for k in links)


def packet(order, interface, p):
    return block(6, struct.pack(order + "5I", interface, 0, len(p), len(p), len(p)) + p + bytes(-len(p) % 4), order)


def pcapng(packets):
    half = len(packets) // 2
    out = section("<", [1, 101]) + b"".join(packet("<", i % 3, p) for i, p in enumerate(packets[:half]))
    out += block(1, struct.pack("<HHI", 113, 0, 0)) + b"".join(packet("<", i % 4, p) for i, p in enumerate(packets[:5]))
    return out + section(">", [276]) + b"".join(packet(">", i % 2, p) for i, p in enumerate(packets[half:]))


def erf(packets):
    return b"".join(struct.pack("<II", i, 1_700_000_000) + struct.pack(">BBHHH", 2, 4, 18 + len(p), 0, len(p)) + bytes(2) + p for i, p in enumerate(packets))


PLAIN = [R.randbytes(R.choice([0, 1, 40, 60, 200, 1500])) for _ in range(400)]
#: Packets that hold captures: what looks like records inside of them has to be told from the records of the file.
NESTED = [R.choice([pcap, erf, pcapng])(PLAIN[i : i + 12])[R.choice([0, 24]) :] for i in range(0, 380, 7)]
FILES = {
    "plain.pcap": pcap(PLAIN),
    "big.pcap": pcap(PLAIN[:200], ">"),
    "nested.pcap": pcap(NESTED),
    "jumbo.pcap": pcap([*PLAIN[:20], R.randbytes(9000), *PLAIN[:20]]),
    "zeros.pcap": pcap([bytes(3000)] * 9),
    "plain.pcapng": pcapng(PLAIN),
    "nested.pcapng": pcapng(NESTED),
    "plain.erf": erf(PLAIN),
    "nested.erf": erf([p[:60000] for p in NESTED]),
    "cut.pcap": pcap(PLAIN[:60])[:-7],
    "broken.pcapng": pcapng(PLAIN[:60])[:3000] + b"\xff" * 500 + pcapng(PLAIN[:9]),
    "plain.gz": gzip.compress(pcap(PLAIN[:50])),
    "header.pcap": pcap([]),
    "empty.pcap": b"",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("captures")
    for name, raw in FILES.items():
        (out / name).write_bytes(raw)
    return str(out)


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_rows_of_one_task(spark, folder, split):
    index = ranges.index(spark, folder, split)
    got = {}
    for r in ranges.read_index(spark, index).collect():
        got.setdefault(r.capture.rsplit("/", 1)[1], []).append((r.num, r.ts_ns, r.wirelen, r.linktype, r.comment, bytes(r.data)))
    for name, raw in FILES.items():
        want = [(i, *x) for i, x in enumerate(captures.records(raw))]
        assert sorted(got.get(name, [])) == want, name
    counts = {r.path.rsplit("/", 1)[1]: r.packets for r in ranges.count(spark, index).collect()}
    assert counts == {n: len(got.get(n, [])) for n in counts}
    assert ranges.read_index(spark, index).rdd.getNumPartitions() > (200 if split == 700 else 5)


def test_wrong_guesses_are_mended(spark, folder, monkeypatch):
    monkeypatch.setattr(ranges, "LIKELY", 1)
    raw, at, starts = FILES["nested.pcap"], 24, set()
    while at < len(raw):
        starts.add(at)
        at += 16 + struct.unpack_from("<I", raw, at + 8)[0]
    guesses = [ranges._walk(f"{folder}/nested.pcap", k, k * 700, (k + 1) * 700, len(raw), -1, "")["start"] for k in range(12)]
    assert set(guesses) - starts - {-1}  # some are taken in by what a packet holds
    got = ranges.read(spark, folder, 700, ["num", "capture", "caplen"], "nested.*").collect()
    want = {n: [len(x[4]) for x in captures.records(FILES[n])] for n in FILES if n.startswith("nested")}
    assert {n: [r.caplen for r in sorted(got) if r.capture.endswith(n)] for n in want} == want


def test_slices_by_num(spark, folder, tmp_path):
    assert ranges.read(spark, str(tmp_path)).count() == 0  # no files
    index = ranges.index(spark, f"{folder}/plain.pcap", 5000)
    whole, few = ranges.read_index(spark, index, ["num"]), ranges.read_index(spark, index, ["num", "data"], 100, 129)
    assert sorted(r.num for r in few.collect()) == list(range(100, 130)) and few.columns == ["num", "data"]
    assert 0 < few.rdd.getNumPartitions() < whole.rdd.getNumPartitions() / 3
    assert whole.count() == 400 and ranges.read_index(spark, index, first=1000).count() == 0


def test_short_ranges_share_tasks(spark, tmp_path):
    """Each packet in a range of its own: a task reads several of them, with every packet and its number."""
    packets = [R.randbytes(100) for _ in range(4000)]
    (tmp_path / "a.pcap").write_bytes(pcap(packets))
    df = ranges.read(spark, str(tmp_path), 116)
    assert df.rdd.getNumPartitions() < 2000
    assert [(r.num, bytes(r.data)) for r in df.orderBy("num").collect()] == list(enumerate(packets))
