"""Tunnels in tunnels, headers that are cut off, and links that hold no packet."""

from pyspark.sql import functions as F

from capquill.operators import dissect as D
from capquill.operators import tunnels
from capquill.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_a_tunnel_in_a_tunnel(spark):
    once = X.tunnelled(spark, SF).where("num & 7 = 1")
    head = F.unhex(F.lit("ffffffffffff020000000001" + "0800" + "4500"))
    twice = once.withColumn("data", F.concat(head, F.unhex(F.lpad(F.hex(F.length("data") + 24), 4, "0")), F.unhex(F.lit("00000000402f00000100000002000000" + "00006558")), "data"))
    a = tunnels.inner(D.capture(twice.select("num", "time", "data")))
    assert {(r.tunnel, r.tunnel_key) for r in a.select("tunnel", "tunnel_key").distinct().collect()} == {("GRE", None)}
    got = {r.num: bytes(r.data) for r in tunnels.inner(a).collect()}
    assert got and got == {r.num: bytes(r.data) for r in X.packets(spark, SF).where("num & 7 = 1").collect()}


def test_frames_that_are_cut_off_or_null(spark):
    frames = [bytes(r.data) for r in X.tunnelled(spark, SF).where("num < 16").collect()]
    rows = [(i, f[:n]) for i, f in enumerate(frames) for n in range(len(f))] + [(99, None)]
    df = D.capture(spark.createDataFrame(rows, "num bigint, data binary")).withColumn("tunnel", F.lit("mine"))
    got = tunnels.inner(df).collect()
    assert got and all(len(r.data) == r.wirelen > 0 and r.tunnel != "mine" for r in got)
    assert tunnels.inner(df.where("false")).count() == 0


def test_other_links(spark):
    rows = [(i, k, d) for i, (k, d) in enumerate([(0, b""), (0, b"\x02"), (113, bytes(15)), (276, bytes(19)), (101, b""), (101, b"\x50abc"), (147, b"\x45" * 30), (None, b"abc")])]
    df = spark.createDataFrame(rows, "num bigint, linktype int, data binary")
    got = {r.num: r.chain for r in D.dissect(D.capture(df)).select("num", "chain").collect()}
    assert got == {0: [], 1: ["Raw"], 2: ["Raw"], 3: ["Raw"], 4: [], 5: ["Raw"], 6: ["Raw"], 7: ["Raw"]}
