"""DNS messages written with compression and read again; DNSSEC data; messages over TCP."""

from pyspark.sql import functions as F

from capquill.operators import reassembly, records
from tests.test_streams import capture, tcp_frames

ROWS = [
    ("qd", "www.example.", "AAAA", 1, None, None),
    ("an", "www.example.", "CNAME", 1, 5, "host.example."),
    ("an", "host.example.", "AAAA", 1, 5, "2001:db8::1"),
    ("an", "host.example.", "TXT", 1, 5, "x" * 600),
    ("an", "host.example.", "SRV", 1, 5, "1 2 3 host.example."),
    ("an", r"odd\.label.example.", "PTR", 1, 5, r"b\\ck.example."),
    ("ns", "example.", "SOA", 1, 5, "ns.example. mail.example. 1 2 3 4 5"),
    ("ns", "example.", "DS", 1, 5, "60485 5 1 2BB183AF5F22588179A53B0A98631FAD1A292118"),
    ("ns", "example.", "DNSKEY", 1, 5, "257 3 8 AwEAAag="),
    ("ns", "example.", "NSEC", 1, 5, "a.example. A NS SOA MX RRSIG NSEC DNSKEY TYPE1234"),
    ("ar", ".", "CAA", 1, 5, "0 issue ca.example"),
    ("ar", "example.", "TYPE99", 1, 5, "0a0b"),
]
KIND = "array<struct<section:string,name:string,type:string,class:bigint,ttl:bigint,data:string>>"


def test_written_and_read_again(spark):
    df = spark.createDataFrame([(0, ROWS), (1, []), (2, None)], f"k int, rows {KIND}")
    out = df.select("k", records.dns_message(F.col("rows"), 7).alias("m")).withColumn("back", records.dns_records(F.col("m"))).collect()
    got = {r.k: r for r in out}
    back = [tuple(x) for x in got[0].back]
    assert back[:-1] == ROWS[:-1] and back[-1][2:] == ("99", 1, 5, "0a0b")
    assert bytes(got[1].m) == bytes.fromhex("00078180") + bytes(8) and got[2].m is None
    assert bytes(got[0].m).count(b"\x07example") == 3  # the first, and within SRV and NSEC, which are never compressed


def test_data_of_signed_zones(spark):
    owner = b"\x01a\x00"
    rrsig = bytes.fromhex("00010502" + "00000e10" + "00000002" + "00000001" + "0a3c") + owner + b"sig"
    nsec3 = bytes.fromhex("0101000c" + "04aabbccdd" + "05") + b"hello" + bytes.fromhex("00064000000000" + "02")
    param = bytes.fromhex("0100000a" + "00")
    records_ = [(46, rrsig), (50, nsec3), (51, param), (46, rrsig[:10]), (43, b"\0"), (47, b"\x09x")]
    message = bytes.fromhex("000181800000") + len(records_).to_bytes(2) + bytes(4)
    message += b"".join(owner + kind.to_bytes(2) + bytes.fromhex("000100000001") + len(x).to_bytes(2) + x for kind, x in records_)
    (r,) = spark.createDataFrame([(message,)], "m binary").select(records.dns_records(F.col("m")).alias("r")).collect()
    data = [x["data"] for x in r.r]
    assert data[0] == "A 5 2 3600 2 1 2620 a. c2ln" and data[1] == "1 1 12 AABBCCDD D1IMOR3F A RRSIG" and data[2] == "1 0 10 -"
    assert data[3:] == [rrsig[:10].hex(), "00", b"\x09x".hex()]  # what is cut off is given as it is


def test_messages_with_lengths(spark):
    bodies = [b"", b"a" * 300, b"last"]
    raw = b"".join(len(b).to_bytes(2) + b for b in bodies) + b"\x00\x09cut"
    for size in (1, 64, 1000):
        df = capture(spark, tcp_frames([(i, raw[i : i + size]) for i in range(0, len(raw), size)]))
        got = sorted((r.at, r.length, bytes(r.body)) for r in reassembly.prefixed_messages(df).collect())
        assert got == [(0, 2, b""), (2, 302, bodies[1]), (304, 6, b"last")]
    df = capture(spark, tcp_frames([(0, raw[:100]), (101, raw[101:])]))  # a gap
    assert [r.at for r in reassembly.prefixed_messages(df).collect()] == [0]
    assert reassembly.prefixed_messages(df, most=200).count() == 1
