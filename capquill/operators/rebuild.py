"""Packets written anew: fields and payloads replaced, then lengths and checksums made right, the innermost layer first.

A batch's frames are taken apart by the layer stack, put together as one array of octets with the new payloads, and then
mended in that array for all frames at once. Lengths are those of IP, IPv6, UDP, PPPoE, GTP-U and 802.3, and change only where a payload
was replaced. Checksums are those of IP, TCP, UDP, ICMP, ICMPv6, IGMP, OSPF and of GRE where it has one. What is pinned ("UDP.chksum", "IP.len") stays
as it was, or as it was set. A transport checksum that can't be known stays too: of a fragment, and of a packet that was clipped
when it was captured (unless its payload was replaced, when it is whole again). UDP's checksum of zero is written as 0xFFFF.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from capquill.operators.dissect import undissected
from capquill.operators.layers import Layer, field
from capquill.operators.stack import Batch, Names, walk

#: Layers with a length field: its place, its octets, and from where on it counts.
LENGTHS = {"IP": ("IP.len", 2, 2, 0), "IPv6": ("IPv6.plen", 4, 2, 40), "UDP": ("UDP.len", 4, 2, 0), "PPPoE": ("PPPoE.len", 4, 2, 6), "GTP_U": ("GTP_U.len", 2, 2, 8)}
#: Where checksums stand, and the protocol in the pseudo header of those that have one.
CHECKSUMS = {"IP": (10, None), "TCP": (16, 6), "UDP": (6, 17), "ICMP": (2, None), "ICMPv6": (2, 58), "IGMP": (2, None), "OSPF": (12, None), "GRE": (4, None)}


def put(b: Batch, rows: np.ndarray, at: np.ndarray, n: int, value: np.ndarray) -> None:
    """Write numbers of n octets into the rows' frames, where they fit in."""
    good = (at >= 0) & (at + n <= b.size[rows])
    where, value = (b.base[rows] + at)[good], value[good]
    for i in range(n):
        b.raw[where + i] = (value >> 8 * (n - 1 - i)) & 0xFF


def word_sums(b: Batch, rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sum of the 16-bit words of start:stop of each row's frame, an odd last octet padded with zero."""
    sums = np.zeros((2, len(b.raw) + 1), np.int64)
    even = np.arange(len(b.raw)) % 2 == 0
    np.cumsum(np.where(even, b.raw, 0), out=sums[0, 1:])
    np.cumsum(np.where(even, 0, b.raw), out=sums[1, 1:])
    stop = np.maximum(start, np.minimum(stop, b.size[rows]))
    low, high = b.base[rows] + start, b.base[rows] + stop
    both = sums[:, high] - sums[:, low]
    return np.where(low % 2 == 1, 256 * both[1] + both[0], 256 * both[0] + both[1])


def complement(total: np.ndarray) -> np.ndarray:
    for _ in range(3):
        total = (total >> 16) + (total & 0xFFFF)
    return 0xFFFF - total


def write_field(b: Batch, layer: Layer, name: str, at: np.ndarray, value: np.ndarray, known: np.ndarray) -> None:
    """Write a numeric field where its layer is, the field exists and a value is known."""
    f = layer.fields[name]
    here = known & (at >= 0)
    if f.when:
        other = layer.fields[f.when[0]]
        here &= np.isin(b.bits(at, other.bit, other.width), f.when[1])
    rows = np.flatnonzero(here)
    first, last = f.bit // 8, (f.bit + f.width - 1) // 8
    n, shift = last - first + 1, 8 * (last + 1) - f.bit - f.width
    mask = ((1 << f.width) - 1) << shift
    old = b.be(at[rows] + first, n, rows)
    put(b, rows, at[rows] + first, n, old & ~mask | value[rows] << shift & mask)


def _mend(b: Batch, names: Names, places: list[tuple[np.ndarray, np.ndarray, np.ndarray]], end: np.ndarray, fresh: np.ndarray, clipped: np.ndarray, pinned: frozenset[str]) -> None:
    """Lengths, then checksums; places: (rows, layers, offsets) of each step of the walk."""
    for rows, layers, at in places:
        for name, (spec, place, n, from_) in LENGTHS.items():
            m = (layers == names.number[name]) & fresh[rows]
            if spec not in pinned and m.any():
                r = rows[m]
                put(b, r, at[m] + place, n, np.minimum(end[r] - at[m] - from_, (1 << 8 * n) - 1))
        m = (layers == names.number["LLC"]) & fresh[rows]
        put(b, rows[m], at[m] - 2, 2, end[rows[m]] - at[m])
    # the network header around each layer, outermost first, and whether what is in it is a part of a datagram only
    around = []
    network, six, part = np.full(len(b.size), -1), np.zeros(len(b.size), bool), np.zeros(len(b.size), bool)
    for rows, layers, at in places:
        around.append((network[rows].copy(), six[rows].copy(), part[rows].copy()))
        for name in ("IP", "IPv6"):
            m = layers == names.number[name]
            r = rows[m]
            network[r], six[r] = at[m], name == "IPv6"
            part[r] = clipped[r] | ((b.be(at[m] + 6, 2, r) & 0x3FFF != 0) if name == "IP" else False)
        m = layers == names.number["IPv6ExtHdrFragment"]
        part[rows[m]] |= b.be(at[m] + 2, 2, rows[m]) & 0xFFF9 != 0
    for (rows, layers, at), (network, six, part) in zip(reversed(places), reversed(around), strict=True):
        for name, (place, proto) in CHECKSUMS.items():
            m = layers == names.number[name]
            if name != "IP":
                m &= ~part
            if name == "GRE":
                m &= b.be(at, 1, rows) & 0x80 != 0
            if proto:
                m &= network >= 0
            if f"{name}.chksum" in pinned or not m.any():
                continue
            r, start, net = rows[m], at[m], network[m]
            stop = start + np.maximum(b.bits(start, 4, 4, r) * 4, 20) if name == "IP" else end[r]
            put(b, r, start + place, 2, np.zeros(len(r), np.int64))
            total = word_sums(b, r, start, stop)
            if proto:
                ends = np.where(six[m], word_sums(b, r, np.where(six[m], net + 8, 0), np.where(six[m], net + 40, 0)), word_sums(b, r, np.where(six[m], 0, net + 12), np.where(six[m], 0, net + 20)))
                total = total + ends + proto + (stop - start)
            value = complement(total)
            put(b, r, start + place, 2, np.where((name == "UDP") & (value == 0), 0xFFFF, value))


def rebuild(df: DataFrame, values: dict[str, Column] | None = None, payload: Column | None = None, pinned: Sequence[str] = ()) -> DataFrame:
    """The capture with fields ("Layer.field" or "Layer:2.field": a number, null for as it is) and the innermost payload (null: as it is) replaced.

    A new payload stands for all that no header of the transport or below holds, and for padding behind it; wirelen follows. Frames with null data stay null. The values may
    be made of the columns of a dissected capture; offsets aren't given out, since lengths may differ.
    """
    wanted, numbers_of = [field(spec) for spec in values or {}], list((values or {}).values())
    for layer, name in wanted:
        if not layer.fields[name].numeric:
            raise ValueError(f"{layer.name}.{name} is no number")
    fixed, names = frozenset(pinned), Names([])
    further = list(dict.fromkeys((layer.name, layer.nth) for layer, _ in wanted if layer.nth > 1))

    @F.arrow_udf(BinaryType())
    def anew(data: pa.Array, linktype: pa.Array, wirelen: pa.Array, body: pa.Array, *numbers: pa.Array) -> pa.Array:
        original = Batch(data, linktype.fill_null(-1).to_numpy(zero_copy_only=False))
        found = walk(original, names, further=further)
        frames, bodies = data.to_pylist(), body.to_pylist()
        fresh = np.array([p is not None and f is not None for f, p in zip(frames, bodies, strict=True)], bool)
        made = [(f[:after] + p if p is not None else f) if f is not None else b"" for f, p, after in zip(frames, bodies, found.after.tolist(), strict=True)]
        b = Batch(pa.array(made, pa.large_binary()), np.zeros(len(made), np.int64))
        for (layer, name), number in zip(wanted, numbers, strict=True):
            at = found.first[layer.name] if layer.nth == 1 else found.further[layer.name, layer.nth]
            write_field(b, layer, name, at, number.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), number.is_valid().to_numpy(zero_copy_only=False))
        clipped = (wirelen.fill_null(0).to_numpy(zero_copy_only=False) > original.size) & ~fresh
        end = np.where(fresh, b.size, found.stop)
        _mend(b, names, found.places, end, fresh, clipped, fixed)
        raw = b.raw.tobytes()
        return pa.array([None if f is None else raw[x : x + n] for f, x, n in zip(frames, b.base.tolist(), b.size.tolist(), strict=True)], pa.binary())

    body = F.lit(None).cast("binary") if payload is None else payload
    new = anew("data", "linktype", F.col("wirelen").cast("bigint"), body, *[v.cast("bigint") for v in numbers_of])
    out = df.withColumn("_new", new)
    wirelen = F.col("wirelen") + F.length("_new") - F.length("data")
    out = out.withColumn("wirelen", F.coalesce(wirelen, "wirelen").cast("bigint")).withColumn("data", F.col("_new")).drop("_new")
    return undissected(out)
