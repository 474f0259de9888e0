"""Stacks of layers: cut off anywhere, tunnels in tunnels, variants of one port, columns of clashing names."""

import numpy as np
import pyarrow as pa

from capquill.operators import dissect as D
from capquill.operators import layers
from capquill.operators.stack import STEPS, Batch, Bind, Names, walk
from capquill.plans import fixtures as X

SF = "/root/testdata/sf0.001"
MACS = bytes.fromhex("ffffffffffff020000000001")


def ip(proto, body, src="0a000001", dst="0a000002"):
    return bytes.fromhex("4500") + (20 + len(body)).to_bytes(2) + bytes(4) + bytes([64, proto, 0, 0]) + bytes.fromhex(src + dst) + body


def udp(sport, dport, body):
    return sport.to_bytes(2) + dport.to_bytes(2) + (8 + len(body)).to_bytes(2) + bytes(2) + body


def tcp(body=b""):
    return bytes.fromhex("04d2005000000001000000005010200000000000") + body


def chains(frames, link=1):
    found = walk(Batch(pa.array(frames, pa.binary()), np.full(len(frames), link)), names := Names([]))
    out = [[] for _ in frames]
    for row, layer in zip(found.chain_rows, found.chain_layers):
        out[row].append(names.names[layer])
    return out, found


FRAMES = {
    "Ether Dot1Q Dot1Q Dot1Q IP TCP": MACS + bytes.fromhex("88a80001810000028100000308" + "00") + ip(6, tcp()),
    "Ether MPLS MPLS MPLS Ether IP UDP Raw": MACS + bytes.fromhex("8847" + "00001040" + "00002040" + "00003140") + MACS + b"\x08\x00" + ip(17, udp(9, 9, b"ab")),
    "Ether IP AH TCP Raw": MACS + b"\x08\x00" + ip(51, bytes.fromhex("06040000" + "00000001" * 2 + "00" * 12) + tcp(b"xy")),
    "Ether IP UDP VXLAN Ether IP UDP VXLAN Ether IP TCP": MACS + b"\x08\x00" + ip(17, udp(1, 4789, bytes(8) + MACS + b"\x08\x00" + ip(17, udp(1, 4789, bytes(8) + MACS + b"\x08\x00" + ip(6, tcp()))))),
    "Ether IP GRE PPP IP TCP": MACS + b"\x08\x00" + ip(47, bytes.fromhex("3081880b" + "00040001" + "00000002" + "00000003" + "0021") + ip(6, tcp())),
    "Ether IP GRE ERSPAN_II Ether ARP": MACS + b"\x08\x00" + ip(47, bytes.fromhex("100088be00000001" + "1000000100000002") + MACS + b"\x08\x06" + bytes(28)),
    "Ether PPPoE PPP PPP_LCP Raw": MACS + bytes.fromhex("8864" + "11000001" + "0008" + "c021" + "01020006" + "0104"),
    "Ether LLC STP": MACS + bytes.fromhex("0026" + "424203") + bytes(35),
    "Ether LLC SNAP IP TCP": MACS + bytes.fromhex("0030" + "aaaa03" + "0000000800") + ip(6, tcp()),
    "Ether IPv6 IPv6ExtHdrFragment Raw": MACS + bytes.fromhex("86dd60000000000a2c40") + bytes(32) + bytes.fromhex("0600000800000001") + b"ab",
    "Ether IP TCP BGPHeader": MACS + b"\x08\x00" + ip(6, bytes.fromhex("00b304d2000000010000000050102000000000" + "00") + b"\xff" * 16 + bytes.fromhex("001304")),
    "Ether IP UDP Radius": MACS + b"\x08\x00" + ip(17, udp(1812, 5, b"\x01\x02\x00\x14" + bytes(16))),
}


def test_chains_and_every_prefix():
    got, _ = chains(list(FRAMES.values()))
    assert [" ".join(c) for c in got] == list(FRAMES)
    cut = [f[:n] for f in FRAMES.values() for n in range(len(f) + 1)]
    got, found = chains(cut)
    for f, c, after, stop in zip(cut, got, found.after, found.stop):
        assert 0 <= after <= len(f) and stop <= len(f) and (c != [] or not f) and c.count("Raw") <= 1 and "Raw" not in c[:-1]


def test_the_deepest_stacks_end():
    got, found = chains([MACS + b"\x81\x00" + b"\x00\x01\x81\x00" * 60, MACS + b"\x08\x00" + b"".join([ip(4, b"")] * 0) + bytes(3)])
    assert len(got[0]) == STEPS and got[0][-1] == "Raw" and got[1] == ["Ether", "Raw"]
    deep = tcp()
    for _ in range(20):
        deep = ip(4, deep)
    names = Names([])
    b = Batch(pa.array([MACS + b"\x08\x00" + deep], pa.binary()), np.array([1]))
    found = walk(b, names, further=[("IP", 3), ("IP", 20), ("IP", 22)])
    assert [int(found.further["IP", k][0]) for k in (3, 20, 22)] == [54, 394, -1]


def test_three_variants_of_one_port(spark):
    a = layers.user_layer("Short", {"kind": layers.Field(0, 8), "x": layers.Field(8, 8)})
    b = layers.user_layer("Long", {"kind": layers.Field(0, 8), "size": layers.Field(8, 24)})
    c = layers.user_layer("Odd", {"kind": layers.Field(0, 8)})
    inner = layers.user_layer("Inner", {"y": layers.Field(0, 16)})
    bind = [
        Bind(c, "UDP", {"dport": 7000}),
        Bind(a, "UDP", {"dport": 7000}, {"kind": 1}, priority=2),
        Bind(b, "UDP", {"dport": range(7000, 7010)}, {"kind": [1, 2]}, priority=1),
        Bind(inner, "Long", {"size": 2}),
    ]
    bodies = [(7000, "0105"), (7000, "020000020009"), (7000, "0900"), (7005, "01000003aa"), (7005, "09"), (7000, "01")]
    rows = [(i, MACS + b"\x08\x00" + ip(17, udp(1, port, bytes.fromhex(x)))) for i, (port, x) in enumerate(bodies)]
    d = D.dissect(D.capture(spark.createDataFrame(rows, "num bigint, data binary")), bind=bind)
    got = {r.num: r for r in d.select("num", "chain", a.value("x").alias("x"), b.value("size").alias("size"), inner.value("y").alias("y")).collect()}
    assert [got[i].chain[3:] for i in range(6)] == [["Short"], ["Long", "Inner"], ["Odd"], ["Long"], ["Raw"], ["Odd"]]
    assert (got[0].x, got[1].size, got[1].y, got[3].size) == (5, 2, 9, 3)


def test_columns_of_clashing_names(spark):
    from pyspark.sql import functions as F

    from capquill.operators import flows

    df = X.packets(spark, SF)
    own = df.select("*", *[F.lit("mine").alias(c) for c in ("end", "chain", "off_Ether", "off_IP", "_after", "_stop", "dissected", "item")])
    want = {tuple(r) for r in flows.protocol_stats(df).collect()}
    assert {tuple(r) for r in flows.protocol_stats(own).collect()} == want
    hexed = lambda x: {tuple(r) for r in D.dissect(x).select("num", F.hex(D.payload())).collect()}
    assert hexed(own) == hexed(df) and D.dissect(own).select("item").first()[0] == "mine"
    assert D.columns(own, ["IP.src"]).count() == df.count()
