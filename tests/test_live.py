"""Streams give what the same packets give at rest; gaps hold octets back, and what is evicted says so."""

import time

import pandas as pd
from pyspark.sql import functions as F

from capquill.operators import dissect as D
from capquill.operators import flows, reassembly
from capquill.plans import fixtures as X
from capquill.streaming import live

SF = "/root/testdata/sf0.001"


def streamed(spark, df, folder):
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def collected(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_sniff_and_windows(spark, tmp_path):
    packets = X.packets(spark, SF).where("num < 2000").coalesce(2)
    stream = streamed(spark, packets, f"{tmp_path}/in")
    seen = []
    q = live.sniff(stream, [("TCP", "dport", "==", 80)], "TCP", lambda df, _: seen.append(df.count()), f"{tmp_path}/sniff")
    assert q.awaitTermination(120) and sum(seen) == D.keep(packets, [("TCP", "dport", "==", 80)], "TCP").count() > 0
    got = collected(spark, live.flow_windows(stream, late="36500 days"), tmp_path, "windows", "complete")
    assert sum(r.packets for r in got) == packets.count() and sum(r.octets for r in got) == packets.agg(F.sum(F.length("data"))).first()[0]
    assert {r.session for r in got} == {r.session for r in flows.sessions(packets).collect()}


def test_octets_in_order(spark, tmp_path):
    rows = [("a", 0, 1, 5, b"world"), ("a", 0, 2, 0, b"hello"), ("a", 0, 3, 3, b"XXXX"), ("b", 1, 4, 4, b"late"), ("c", 0, 5, 9, b"z" * 50)]
    df = spark.createDataFrame(rows, "stream string, direction int, num bigint, rel bigint, body binary").coalesce(1)
    # a query with a timeout by the clock never ends by itself
    q = live.follow(streamed(spark, df, f"{tmp_path}/in"), most=20).writeStream.format("memory").queryName("octets").outputMode("append").option("checkpointLocation", f"{tmp_path}/octets").start()
    until = time.time() + 60
    while time.time() < until and spark.table("octets").count() < 3:
        time.sleep(1)
    q.stop()
    got = spark.table("octets").collect()
    out = pd.DataFrame([(r.stream, r.at, bytes(r.octets), r.evicted) for r in got], columns=["stream", "at", "octets", "evicted"]).sort_values("at")
    assert b"".join(out[out["stream"] == "a"]["octets"]) == b"helloworld" and not out[out["stream"] == "a"]["evicted"].any()
    assert out[out["stream"] == "b"].empty  # octets 0 to 3 are missing
    assert out[out["stream"] == "c"][["at", "octets", "evicted"]].values.tolist() == [[9, b"z" * 50, True]]


def test_fragments_of_many_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    whole = X.datagrams(spark, SF).where("shiftright(num, 16) < 25")
    pieces = reassembly.fragment(whole, 600).select((F.col("num") * 1000 + F.col("piece")).alias("num"), "data").toPandas().sort_values("num")
    rows = [(int(n), 10.0 + i / 1000, bytes(d)) for i, (n, d) in enumerate(zip(pieces["num"], pieces["data"]))]
    old = [(n, t + 500, d) for n, t, d in rows[-1:]]
    rows = [r for r in rows if r[0] != rows[-1][0]]
    batches = [rows[::3], rows[1::3], rows[2::3], [(2 * 10**9, 900.0, b"no fragment at all")], old]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "num bigint, time double, data binary").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = lambda reader: D.capture(reader.schema("num bigint, time double, data binary").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    stream = files(spark.readStream.option("maxFilesPerTrigger", 1))
    got = collected(spark, live.defragmented(stream, age=60.0, late="1000 seconds"), tmp_path, "defragmented")
    want = reassembly.defragment(files(spark.read), age=60.0).collect()
    key = lambda r: (r.kind, r.num, bytes(r.data), r.fragments)
    assert [r for r in sorted(map(key, got)) if r[0] == "complete"] == [r for r in sorted(map(key, want)) if r[0] == "complete"] != []
    at_rest = live.defragmented(files(spark.read), age=60.0).collect()  # no timer runs out here
    assert sorted(key(r) for r in at_rest if r.kind != "incomplete") == sorted(key(r) for r in want if r.kind != "incomplete")


def test_given_up_fragments_come_out(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def piece(at, more, body):
        return bytes(12) + b"\x08\x00\x45\x00" + (20 + len(body)).to_bytes(2) + b"\x00\x07" + (at // 8 | more << 13).to_bytes(2) + bytes([64, 17, 0, 0]) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + body

    batches = [[(0, 1.0, piece(0, 1, b"o" * 8))], [(1, 200.0, b"later")], [(2, 210.0, piece(8, 0, b"n" * 8)), (3, 211.0, piece(0, 1, b"n" * 8))], [(4, 400.0, b"end")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "num bigint, time double, data binary").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("num bigint, time double, data binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = collected(spark, live.defragmented(D.capture(stream), age=60.0, late="1 seconds"), tmp_path, "given_up")
    assert sorted((r.num, r.kind, bytes(r.data)[34:]) for r in got if r.kind != "whole") == [(0, "incomplete", b"o" * 8), (2, "complete", b"n" * 16)]
