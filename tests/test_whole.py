"""What long texts, many documents and long captures come to: nothing is left out."""

from hashlib import md5

from pyspark.sql import functions as F

from capquill.operators import dissect as D
from capquill.operators import reassembly
from capquill.plans import fixtures as X
from capquill.plans.queries import QUERIES


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_long_texts_and_distant_documents(spark, tmp_path):
    texts = {i + far: f"{i} {far} " * 400 for far in (0, 65536, 1 << 24, 1 << 40) for i in (1, 2)} | {7: "é" * 70000, 8: ""}
    sf = documents(spark, tmp_path, [*texts.items(), (9, None)])
    got = {r.num: r.md5 for r in QUERIES["defrag_roundtrip"](spark, sf).collect()}
    assert set(got) == set(texts) and got[7] == md5(texts[7].encode()).hexdigest()
    pieces = reassembly.fragment(X.datagrams(spark, sf), 1000)
    whole = reassembly.defragment(D.capture(pieces.select((F.col("num") * 100 + F.col("piece")).alias("num"), "data")))
    parts = D.dissect(D.capture(whole)).select(F.floor(F.col("num") / 100).alias("num"), D.payload().alias("body")).orderBy("num").collect()
    found = {}
    for r in parts:
        found[r.num // X.DATAGRAMS] = found.get(r.num // X.DATAGRAMS, b"") + bytes(r.body or b"")
    assert found == {k: v.encode() for k, v in texts.items()}


def ipv4(body, ident, flags, src="0a000001"):
    """An IPv4 frame with this word of flags and offset."""
    return bytes.fromhex("ffffffffffff0200000000010800" + "4500") + (20 + len(body)).to_bytes(2) + ident.to_bytes(2) + flags.to_bytes(2) + bytes.fromhex("40110000" + src + "0a000002") + body


def test_defragment_gives_out_every_frame(spark):
    first, second, third = (bytes([c]) * 40 for c in b"abc")
    halves = lambda of, ident: [ipv4(of[:24], ident, 0x2000), ipv4(of[24:], ident, 3)]
    a, b, c = (halves(x, 5) for x in (first, second, third))
    other = bytes.fromhex("ffffffffffff020000000001" + "0806") + bytes(46)
    frames = [a[1], a[0], b[0], b[1], c[1], other, ipv4(b"alone", 5, 0), *halves(first, 6)[:1]]
    df = D.capture(spark.createDataFrame([(i, x) for i, x in enumerate(frames)], "num bigint, data binary"))
    got = {r.num: r for r in reassembly.defragment(df).collect()}
    assert {k: (r.kind, r.fragments) for k, r in got.items()} == {0: ("complete", 2), 2: ("complete", 2), 4: ("incomplete", 1), 5: ("whole", 1), 6: ("whole", 1), 7: ("incomplete", 1)}
    assert [bytes(got[k].data)[34:] for k in (0, 2)] == [first, second]
    assert all(bytes(got[k].data) == frames[k] for k in (4, 5, 6, 7))
    summed = D.dissect(D.capture(spark.createDataFrame([(k, got[k].data) for k in (0, 2)], "num bigint, data binary"))).select(F.length("data").alias("n"), D.layer_column("IP.len").alias("len"), D.layer_column("IP.flags").alias("flags"))
    assert {tuple(r) for r in summed.collect()} == {(74, 60, "")}


def test_overlaps_and_repeats_of_fragments(spark):
    old, new = b"o" * 40, b"n" * 40
    frames = [ipv4(old[:24], 1, 0x2000), ipv4(new[:24], 1, 0x2000), ipv4(new[:24], 1, 0x2002), ipv4(old[24:], 1, 3)]
    df = D.capture(spark.createDataFrame([(i, x) for i, x in enumerate(frames)], "num bigint, data binary"))
    (r,) = reassembly.defragment(df).collect()
    assert (r.num, r.kind, r.fragments) == (0, "complete", 4) and bytes(r.data)[34:] == b"o" * 24 + b"n" * 16


def test_pages_far_apart_and_large(spark, tmp_path):
    pages = {i + far: f"<p>{i} {far}</p>" * 300 for far in (0, 65536, 1 << 40) for i in (1, 2)} | {7: "<br>" * 400_000}
    spark.createDataFrame(list(pages.items()), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id for r in QUERIES["http_messages"](spark, str(tmp_path)).collect()} == set(pages)
    bodies = [bytes(r.body) for r in reassembly.http_messages(X.web(spark, str(tmp_path))).collect()]
    assert sorted(bodies) == sorted(x.encode() for x in pages.values())


def segments(octets, client, lost=(), size=1000):
    """TCP frames of the octets, without those of the given places."""
    tcp = lambda at: (2000).to_bytes(2) + (80).to_bytes(2) + (at + 1).to_bytes(4) + bytes(4) + bytes.fromhex("501800000000" + "0000") + octets[at : at + size]
    return [ipv4(tcp(at), 0, 0, src=f"0a0001{client:02x}").replace(b"\x40\x11", b"\x40\x06", 1) for at in range(0, len(octets), size) if at // size not in lost]


def test_messages_before_a_gap_and_over_blocks(spark):
    post = lambda n: b"POST / HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n
    chunked = b"POST /c HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n4;a=b\r\nabcd\r\n1000\r\n" + b"y" * 4096 + b"\r\n0\r\nTrailer: 1\r\n\r\n"
    long, bad = (chunked + post(300_000)) * 60, post(10) + b"POST / HTTP/1.1\r\nContent-Length: many\r\n\r\n" + post(10)
    lost, plain = post(900) * 20, post(5) + chunked
    frames = [*segments(long, 1, size=50_000), *segments(lost, 2, lost={15}), *segments(plain, 3, size=7), *segments(bad, 4)]
    df = D.capture(spark.createDataFrame(list(enumerate(frames)), "num bigint, data binary"))
    sizes = {c: [] for c in (1, 2, 3, 4)}
    for r in reassembly.http_messages(df).select("stream", F.length("body").alias("n")).orderBy("at").collect():
        sizes[next(c for c in sizes if f"10.0.1.{c}:" in r.stream)].append(r.n)
    assert len(long) > 16 << 20 and sizes[1] == [4100, 300_000] * 60
    assert sizes[2] == [900] * (15_000 // len(post(900))) and sizes[3] == [5, 4100] and sizes[4] == [10]
