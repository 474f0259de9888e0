"""Dissection and the analytic path: layer offsets by one vectorized function, everything else native expressions.

A capture is a DataFrame (num, time, wirelen, linktype, data); more columns pass. `dissect` walks the headers of
Arrow batches of frames with numpy, all frames of a batch at once, and adds one offset
column per layer, of its first occurrence and null where it is absent, the end of the network packet
(`end`, of the outermost one), the offset of what no layer claims (`off_Raw`), where the innermost payload begins and ends
(`_after`, `_stop`) and the names of the chain. Fields are read from these offsets by the specifications, so only those that a
query names are decoded. `stack` has the rules of the layers; `tunnels.inner` gives the frames within tunnels.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from capquill.functions import octets as O
from capquill.operators.layers import LAYERS, Layer, decoded_name, field
from capquill.operators.stack import Batch, Bind, Found, Names, binds_of, walk

CAPTURE = "num bigint, time double, wirelen bigint, linktype int, data binary"


def capture(frames: DataFrame) -> DataFrame:
    """A capture from frames with num and data; time, wirelen and linktype are filled in if missing."""
    have = set(frames.columns)
    added = {"time": F.lit(0.0), "wirelen": F.length("data").cast("bigint"), "linktype": F.lit(1)}
    return frames.withColumns({k: v for k, v in added.items() if k not in have})


def dissect(df: DataFrame, bind: Sequence[Bind | tuple] = (), fields: Sequence[str] = (), slim: Sequence[str] | None = None) -> DataFrame:
    """df with offsets. bind: `Bind`s, or (layer, parent layer, {field of the parent: value}), which place layers over payloads before any other rule.

    fields: "Layer.field" names ("Layer:3.field" of a third occurrence) whose numbers are decoded in the same pass, into columns for
    `Layer.raw(decoded=True)`. slim: give out just these of the columns with offsets, ends and the chain, so that less is moved. Columns
    of the input with names that dissection uses (off_<Layer>, end, chain, _after, _stop) are replaced, unless the capture is dissected already.
    """
    wanted = [(layer, name) for layer, name in dict.fromkeys(map(field, fields)) if layer.fields[name].numeric]
    if is_dissected(df):
        if not all(decoded_name(*w) in df.columns for w in wanted):
            raise ValueError("the capture is dissected already, without these fields")
        return df
    binds = binds_of(bind)
    names = Names(binds)
    further = list(dict.fromkeys([("IP", 2), *((layer.name, layer.nth) for layer, _ in map(field, fields) if layer.nth > 1)]))
    anchors = {f"off_{n}": (n, 1) for n in [*names.names[1:], "Raw"]} | {f"off_{n}_{k}": (n, k) for n, k in further}
    anchors = {a: of for a, of in anchors.items() if slim is None or a in slim}
    shown = pa.array([*names.names, "Padding"])
    ends = [c for c in ("_after", "_stop", "end") if slim is None or c in slim]
    chained = slim is None or "chain" in slim
    kind = ", ".join([*(f"{a}: int" for a in (*anchors, *ends)), *["chain: array<string>"] * chained, *(f"{decoded_name(*w)}: bigint" for w in wanted), "dissected: boolean"])

    @F.arrow_udf(f"struct<{kind}>")
    def offsets(data: pa.Array, linktype: pa.Array) -> pa.Array:
        batch = Batch(data, linktype.fill_null(-1).to_numpy(zero_copy_only=False))
        found = walk(batch, names, binds, further)

        def place(name: str, nth: int) -> np.ndarray:
            return found.first[name] if nth == 1 else found.further[name, nth]

        def integer(v: np.ndarray) -> pa.Array:
            return pa.array(v.astype(np.int32), pa.int32(), mask=v < 0)

        def decoded(layer: Layer, name: str) -> pa.Array:
            f, where = layer.fields[name], place(layer.name, layer.nth)
            gone = where < 0
            if f.when:
                other = layer.fields[f.when[0]]
                gone = gone | ~np.isin(batch.bits(where, other.bit, other.width), f.when[1])
            return pa.array(batch.bits(where, f.bit, f.width), pa.int64(), mask=gone)

        parts = {a: integer(place(*of)) for a, of in anchors.items()}
        parts |= {c: integer({"_after": found.after, "_stop": found.stop, "end": found.end}[c]) for c in ends}
        if chained:
            parts["chain"] = _chains(found, batch, shown)
        parts |= {decoded_name(*w): decoded(*w) for w in wanted}
        parts["dissected"] = pa.repeat(True, len(data))
        return pa.StructArray.from_arrays(list(parts.values()), names=list(parts))

    # as a nondeterministic function it is called once a row, and filters on offsets aren't merged into it
    made = {*anchors, *ends, *["chain"] * chained, *(decoded_name(*w) for w in wanted)}
    out = df.withColumn("_at", offsets.asNondeterministic()("data", "linktype"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[F.col(f"_at.{c}") for c in made], *[F.col("_at.dissected").alias(DISSECTED)] * (slim is None))


#: Tells a dissected capture from one that has such columns by chance.
DISSECTED = "_dissected"


def is_dissected(df: DataFrame) -> bool:
    return DISSECTED in df.columns


def undissected(df: DataFrame) -> DataFrame:
    """A dissected capture without what dissection added."""
    made = re.compile(r"off_\w+|_field_\w+|_after|_stop|end|chain|" + DISSECTED)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not made.fullmatch(c)]) if is_dissected(df) else df


def _chains(found: Found, b: Batch, shown: pa.Array) -> pa.Array:
    """Names of the layers of each frame in order, Padding last."""
    padded = np.flatnonzero(found.end < b.size)
    rows = np.concatenate([found.chain_rows, padded])
    layers = np.concatenate([found.chain_layers, np.full(len(padded), len(shown) - 1)])
    order = np.argsort(rows, kind="stable")
    first = np.searchsorted(rows[order], np.arange(len(b.size) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), shown.take(pa.array(layers[order])))


def layer_column(spec: str | tuple, rendered: bool = False, decoded: bool = False) -> Column:
    """The column of "Layer.field", of a field of Frame (num, time, len), or of "Layer" alone (its presence)."""
    text = spec if isinstance(spec, str) else ".".join(spec[:2])
    if "." not in text:
        return F.col(f"off_{text}").isNotNull()
    if text.startswith("Frame."):
        return {"num": F.col("num"), "time": F.col("time"), "len": F.length("data").cast("bigint")}[text[6:]]
    layer, name = field(text)
    return layer.rendered(name, decoded) if rendered else layer.value(name, decoded)


def _needed(specs: Sequence[str | tuple], where: Sequence[tuple]) -> list[str]:
    """Those of the fields that frames don't have by themselves."""
    named = [s if isinstance(s, str) else ".".join(s[:2]) for s in specs] + [".".join(c[:2]) for c in where]
    return [n for n in named if "." in n and not n.startswith("Frame.")]


def columns(df: DataFrame, specs: Sequence[str | tuple], where: Sequence[tuple] = (), layer: str | None = None) -> DataFrame:
    """One row per kept packet and one column per spec: "IP.src" or (layer, field[, name])."""
    names = [s if isinstance(s, str) else s[2] if len(s) > 2 else ".".join(s) for s in specs]
    if len(set(names)) < len(names):
        raise ValueError("duplicate output names")
    ready = is_dissected(df)
    if not ready:
        asked = _needed(specs, where)
        present = [s if isinstance(s, str) else ".".join(s[:2]) for s in specs] + [layer or "Ether"]
        anchors = [field(n)[0].anchor for n in asked] + [f"off_{n}" for n in present if "." not in n]
        df = dissect(df, fields=asked, slim=anchors)
    kept = keep(df, where, layer, decoded=not ready, ready=True)
    return kept.select(*[layer_column(s, decoded=not ready).alias(n) for s, n in zip(specs, names, strict=True)])


_OPERATORS = {"==": "==", "=": "==", "eq": "==", "!=": "!=", "ne": "!=", "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">="}


def _literal(layer: Layer, name: str, value) -> object:
    """A value given by the user as the raw value of a field."""
    f = layer.fields[name]
    if isinstance(value, int) or not isinstance(value, str):
        return value
    if f.kind == "ipv4":
        quad = value.split(".")
        if len(quad) != 4 or not all(q.isdigit() and int(q) < 256 for q in quad):
            raise ValueError(f"no IPv4 address: {value}")
        return sum(int(q) << (24 - 8 * i) for i, q in enumerate(quad))
    if f.kind == "mac":
        return bytes.fromhex(value.replace(":", ""))
    if f.kind == "ipv6":
        import ipaddress

        return ipaddress.IPv6Address(value).packed
    flags = value.split(f.between) if f.between else list(value)
    if f.kind == "flags" and set(flags) <= set(f.letters):
        return sum(1 << f.letters.index(c) for c in set(flags))
    if value.isdigit():
        return int(value)
    named = {label: number for number, label in f.names.items()}
    if value in named:
        return named[value]
    raise ValueError(f"no value of {layer.name}.{name}: {value}")


def predicate(conditions: Sequence[tuple], decoded: bool = False) -> Column:
    """AND of (layer, field, op, value); a condition on an absent layer or inactive field is false, != as well."""
    out = F.lit(True)
    for c in conditions:
        layer, name, op, value = c if len(c) == 4 else (*c[:2], "==", c[2])
        op = _OPERATORS[op]
        if layer == "Frame":
            left, right = layer_column(f"Frame.{name}"), F.lit(value)
        else:
            spec, name = field((layer, name))
            left, right = spec.raw(name, decoded), F.lit(_literal(spec, name, value))
        test = {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        out = out & F.coalesce(test, F.lit(False))
    return out


def keep(df: DataFrame, where: Sequence[tuple] = (), layer: str | None = None, decoded: bool = False, ready: bool = False) -> DataFrame:
    """The packets that have the layer and meet the conditions; decoded: as `dissect` was given their fields; ready: it was called."""
    df = df if ready else dissect(df)
    if layer:
        df = df.where(F.col(f"off_{layer}").isNotNull())
    return df.where(predicate(where, decoded)) if where else df


def payload() -> Column:
    """Octets that no header of the transport or below holds."""
    return O.part(F.col("data"), F.col("_after"), F.greatest(F.col("_stop") - F.col("_after"), F.lit(0)))


def padding() -> Column:
    """Octets after the end of the network packet; null where there are none."""
    return F.when(F.col("end") < F.length("data"), O.part(F.col("data"), F.col("end"), F.length("data") - F.col("end")))


def is_plain_padding() -> Column:
    """Padding of one octet, repeated."""
    h = F.hex(padding())
    return h == F.repeat(F.substring(h, 1, 2), (F.length(h) / 2).cast("int"))


def _word_sums(b: Batch, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sum of the 16-bit words of start:stop of each frame, an odd last octet padded with zero; running sums over all octets, no loop over frames."""
    sums = np.zeros((2, len(b.raw) + 1), np.int64)
    even = np.arange(len(b.raw)) % 2 == 0
    np.cumsum(np.where(even, b.raw, 0), out=sums[0, 1:])
    np.cumsum(np.where(even, 0, b.raw), out=sums[1, 1:])
    good = (start >= 0) & (stop > start)
    low = np.where(good, b.base + start, 0)
    high = np.where(good, b.base + np.minimum(stop, b.size), 0)
    both = sums[:, high] - sums[:, low]
    odd = low % 2 == 1
    return np.where(odd, 256 * both[1] + both[0], 256 * both[0] + both[1])


def _complement(total: np.ndarray) -> np.ndarray:
    for _ in range(3):
        total = (total >> 16) + (total & 0xFFFF)
    return 0xFFFF - total


@F.arrow_udf(LongType())
def _ip_sum(data: pa.Array, ip: pa.Array) -> pa.Array:
    b, at = Batch(data, np.zeros(len(data))), ip.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    head = np.maximum(b.bits(at, 4, 4) * 4, 20)
    return pa.array(_complement(_word_sums(b, at, at + head) - b.be(np.where(at < 0, -1, at + 10), 2)), mask=at < 0)


@F.arrow_udf(LongType())
def _transport_sum(data: pa.Array, ip: pa.Array, ip6: pa.Array, at: pa.Array, end: pa.Array, proto: pa.Array, field_at: pa.Array) -> pa.Array:
    b = Batch(data, np.zeros(len(data)))
    ip, ip6, at, end, proto, field_at = (x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ip, ip6, at, end, proto, field_at))
    ends = np.where(ip >= 0, _word_sums(b, np.where(ip < 0, -1, ip + 12), ip + 20), _word_sums(b, np.where(ip6 < 0, -1, ip6 + 8), ip6 + 40))
    total = ends + proto + (end - at) + _word_sums(b, at, end) - b.be(np.where(at < 0, -1, at + field_at), 2)
    value = _complement(total)
    value = np.where((proto == 17) & (value == 0), 0xFFFF, value)
    return pa.array(value, mask=(at < 0) | ((ip < 0) & (ip6 < 0)))


def ip_checksum() -> Column:
    """Header checksum that the IPv4 header should carry; null without one."""
    return _ip_sum("data", "off_IP")


#: Transport layers with a checksum over a pseudo header: protocol, and where it stands.
_SUMMED = {"TCP": (6, 16), "UDP": (17, 6), "ICMPv6": (58, 2)}


def transport_checksum(layer: str) -> Column:
    """Checksum that TCP or UDP over IPv4 or IPv6, or ICMPv6, should carry; UDP's zero is sent as 0xFFFF."""
    proto, field_at = _SUMMED[layer]
    ip = F.coalesce(F.col("off_IP_2"), F.col("off_IP"))
    return _transport_sum(F.col("data"), ip, F.col("off_IPv6"), F.col(f"off_{layer}"), F.col("end"), F.lit(proto), F.lit(field_at))


@F.arrow_udf(LongType())
def _plain_sum(data: pa.Array, at: pa.Array, end: pa.Array) -> pa.Array:
    b, at, end = Batch(data, np.zeros(len(data))), *(x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (at, end))
    return pa.array(_complement(_word_sums(b, at, end) - b.be(np.where(at < 0, -1, at + 2), 2)), mask=at < 0)


def icmp_checksum() -> Column:
    """Checksum that ICMP should carry."""
    return _plain_sum("data", "off_ICMP", "end")


def recompute(df: DataFrame) -> DataFrame:
    """df with the checksums of IPv4, TCP, UDP, ICMP and ICMPv6 written into data."""
    put = lambda data, at, value: F.concat(O.part(data, 0, at), O.octets(value, 2), O.part(data, at + 2, F.length(data)))
    out = dissect(df)
    sums = [(name, at, transport_checksum(name)) for name, (_, at) in _SUMMED.items()] + [("ICMP", 2, icmp_checksum()), ("IP", 10, ip_checksum())]
    for name, at, value in sums:
        here = F.col(f"off_{name}")
        out = out.withColumn("_sum", value).withColumn("data", F.when(F.col("_sum").isNotNull(), put(F.col("data"), here + at, F.col("_sum"))).otherwise(F.col("data"))).drop("_sum")
    return out


_DIRECTIVE = re.compile(r"%%|%(?:(?P<fmt>[^%,.a-zA-Z]*)(?P<raw>r)?,)?(?P<spec>(?:[A-Za-z0-9_]+(?::\d)?\.)?[a-z_0-9]+|\.time)%|\{(?P<neg>!?)(?P<layer>[A-Za-z0-9]+):")


def sprintf(template: str) -> Column:
    """Text of a packet: %Layer.field%, %r,Layer.field% (raw), %.time%, %%, {Layer:shown if present}, {!Layer:if absent}. A directive of an unknown field stays as it is."""

    def walk(at: int, depth: int) -> tuple[Column, int]:
        pieces, plain = [], ""
        while at < len(template):
            if depth and template[at] == "}":
                break
            m = _DIRECTIVE.match(template, at)
            if not m:
                plain, at = plain + template[at], at + 1
                continue
            if m[0] == "%%":
                plain, at = plain + "%", m.end()
                continue
            pieces.append(F.lit(plain))
            plain = ""
            if m["layer"]:
                if depth >= 64:
                    raise ValueError("blocks nest too deeply")
                inside, at = walk(m.end(), depth + 1)
                at += 1
                here = F.array_contains("chain", m["layer"])
                pieces.append(F.when(~here if m["neg"] else here, inside).otherwise(""))
                continue
            at = m.end()
            if m["spec"] == ".time":
                pieces.append(F.date_format(F.timestamp_micros((F.col("time") * 1_000_000).cast("bigint")), "HH:mm:ss.SSSSSS"))
                continue
            try:
                value = layer_column(m["spec"], rendered=not m["raw"]).cast("string")
            except ValueError:  # no such field: the directive is text
                plain += m[0]
                continue
            value = F.coalesce(value, F.lit("??"))
            if m["fmt"]:
                value = F.format_string(f"%{m['fmt']}s", value)
            pieces.append(value)
        return F.concat(*pieces, F.lit(plain)), at

    return walk(0, 0)[0]


def summary() -> Column:
    """One line: the chain of names, and the ends of the innermost known conversation."""
    v = lambda s: layer_column(s).cast("string")
    src, dst = F.coalesce(v("IP.src"), v("IPv6.src")), F.coalesce(v("IP.dst"), v("IPv6.dst"))
    ports = lambda n: F.concat(src, F.lit(":"), v(f"{n}.sport"), F.lit(" > "), dst, F.lit(":"), v(f"{n}.dport"))
    rule = F.when(F.col("off_TCP").isNotNull(), F.concat(ports("TCP"), F.lit(" "), v("TCP.flags")))
    rule = rule.when(F.col("off_UDP").isNotNull(), ports("UDP"))
    rule = rule.when(F.col("off_ICMP").isNotNull(), F.concat(src, F.lit(" > "), dst, F.lit(" "), layer_column("ICMP.type", True)))
    rule = rule.when(F.col("off_ARP").isNotNull(), F.concat(layer_column("ARP.op", True), F.lit(" "), v("ARP.psrc"), F.lit(" > "), v("ARP.pdst")))
    rule = rule.when(src.isNotNull(), F.concat(src, F.lit(" > "), dst))
    return F.concat_ws(" ", F.concat_ws(" / ", F.filter("chain", lambda c: c != "Padding")), rule)


def as_json(layers: Sequence[str]) -> Column:
    """A JSON object of the fields of those of the layers that a packet has, octets as hex."""
    def shown(layer: Layer) -> Column:
        cells = [(F.lower(F.hex(layer.value(n))) if f.kind == "bytes" else layer.value(n)).alias(n) for n, f in layer.fields.items()]
        return F.when(F.col(layer.anchor).isNotNull(), F.struct(*cells)).alias(layer.name)

    return F.to_json(F.struct(*[shown(LAYERS[n]) for n in layers]))


def show(layers: Sequence[str]) -> Column:
    """A line for each layer that a packet has, of those named, and an indented one for each of its fields."""

    def lines(layer: Layer) -> Column:
        cells = [F.concat(F.lit(f"  {n:<12}= "), layer.rendered(n)) for n in layer.fields]
        return F.when(F.col(layer.anchor).isNotNull(), F.concat_ws("\n", F.lit(f"###[ {layer.name} ]###"), *cells))

    return F.concat_ws("\n", *[lines(LAYERS[n]) for n in layers])


def host(address: str) -> Column:
    """Packets from or to an IPv4 address."""
    return predicate([("IP", "src", "==", address)]) | predicate([("IP", "dst", "==", address)])


def net(cidr: str) -> Column:
    """Packets from or to an IPv4 network."""
    address, length = cidr.split("/")
    number, shift = _literal(*field("IP.src"), address), 32 - int(length)
    inside = lambda end: F.coalesce(F.shiftright(field(f"IP.{end}")[0].raw(end), shift) == number >> shift, F.lit(False))
    return inside("src") | inside("dst")


def port(number: int, layers: Sequence[str] = ("TCP", "UDP", "SCTP")) -> Column:
    """Packets from or to a port of one of the layers."""
    out = F.lit(False)
    for layer in layers:
        out = out | predicate([(layer, "sport", "==", number)]) | predicate([(layer, "dport", "==", number)])
    return out
