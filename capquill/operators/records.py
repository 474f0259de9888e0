"""Lists inside of frames: TLV items, TCP options, DNS records, BER values, repeating groups and header lines.

Each function makes a column of an array of structs from octets; `explode` gives a row for each item. Lists are given whole:
an item takes an octet at least, so a walk ends with its octets. Walks stop, never fail, where a list is truncated or its lengths lie: what was read before stays. Null octets
give null.
"""

from __future__ import annotations

import base64
import binascii
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capquill.functions import octets as O
from capquill.operators.layers import Layer

#: Jumps in a DNS name at most.
JUMPS = 64


def _lists(kind: T.StructType, walk: Callable[[bytes], Iterator[tuple]]):
    """An Arrow function from octets to an array of structs."""
    names = kind.names

    def run(data: pa.Array) -> pa.Array:
        out = []
        for value in data.to_pylist():
            out.append(None if value is None else [dict(zip(names, item, strict=True)) for item in walk(value)])
        return pa.array(out, arrow)

    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    arrow = pa.list_(pa.struct([(f.name, kinds[f.dataType]) for f in kind.fields]))
    run.__annotations__ = {"data": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(kind))


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def tlv(data: Column, *, code: int = 1, length: int = 1, whole: bool = False, single: tuple[int, ...] = (), last: tuple[int, ...] = ()) -> Column:
    """array<struct<code, at, value>> of type-length-value items.

    code, length: octets of type and length; whole: the length counts the item's own header; single: types of one octet
    without a length; last: types after which the list ends.
    """

    def walk(b: bytes) -> Iterator[tuple]:
        at = 0
        while at + code <= len(b):
            kind = int.from_bytes(b[at : at + code], "big")
            if kind in single or kind in last:
                yield kind, at, b""
                if kind in last:
                    return
                at += code
                continue
            if at + code + length > len(b):
                return
            n = int.from_bytes(b[at + code : at + code + length], "big") - (code + length if whole else 0)
            begin = at + code + length
            if n < 0 or begin + n > len(b):
                return
            yield kind, at, b[begin : begin + n]
            at = begin + n

    return _lists(_struct(code=T.LongType(), at=T.IntegerType(), value=T.BinaryType()), walk)(data)


#: TCP option numbers and names.
TCP_OPTIONS = {0: "EOL", 1: "NOP", 2: "MSS", 3: "WScale", 4: "SAckOK", 5: "SAck", 8: "Timestamp"}
#: Some DHCP option numbers and names.
DHCP_OPTIONS = {1: "subnet_mask", 3: "router", 6: "name_server", 12: "hostname", 15: "domain", 50: "requested_addr", 51: "lease_time", 53: "message-type", 54: "server_id", 55: "param_req_list", 61: "client_id"}


def _named(items: Column, names: dict[int, str]) -> Column:
    """Items with their names, and what they hold as a number if it is up to four octets."""
    label = lambda code: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code.cast("int")), code.cast("string"))
    number = lambda v: F.when(F.length(v).between(1, 4), O.number(v))
    return F.transform(items, lambda i: F.struct(label(i["code"]).alias("name"), i["code"].alias("code"), number(i["value"]).alias("number"), i["value"].alias("value")))


def tcp_options() -> Column:
    """array<struct<name, code, number, value>> of a dissected packet; null without TCP."""
    at = F.col("off_TCP")
    size = O.bits(F.col("data"), at, 96, 4) * 4 - 20
    return F.when(at.isNotNull(), _named(tlv(O.part(F.col("data"), at + 20, F.greatest(size, F.lit(0))), whole=True, single=(1,), last=(0,)), TCP_OPTIONS))


def ip_options() -> Column:
    """array<struct<code, at, value>> of an IPv4 header's options; null without IPv4."""
    at = F.col("off_IP")
    size = O.bits(F.col("data"), at, 4, 4) * 4 - 20
    return F.when(at.isNotNull(), tlv(O.part(F.col("data"), at + 20, F.greatest(size, F.lit(0))), whole=True, single=(1,), last=(0,)))


def dhcp_options() -> Column:
    """array<struct<name, code, number, value>> after the magic cookie of a BOOTP message; null without one."""
    at, data = F.col("off_BOOTP"), F.col("data")
    here = at.isNotNull() & (O.be(data, at + 236, 4) == 0x63825363)
    return F.when(here, _named(tlv(O.part(data, at + 240, F.greatest(F.col("end") - at - 240, F.lit(0))), single=(0,), last=(255,)), DHCP_OPTIONS))


def option_value(options: Column, name: str) -> Column:
    """The number of the first option of that name."""
    return F.try_element_at(F.filter(options, lambda o: o["name"] == name), F.lit(1))["number"]


def timestamp_value(options: Column) -> Column:
    """The sender's time of TCP's Timestamp option."""
    found = F.try_element_at(F.filter(options, lambda o: (o["name"] == "Timestamp") & (F.length(o["value"]) == 8)), F.lit(1))
    return O.number(O.part(found["value"], 0, 4)) + F.when(found.isNull(), F.lit(None)).otherwise(0)


def dns_name(message: bytes, at: int) -> tuple[str, int] | None:
    """(name with a final dot, offset after it); None if it runs out of the message, over 255 octets or in circles."""
    labels, after, jumps, size = [], -1, 0, 0
    while at < len(message):
        n = message[at]
        if n >= 0xC0:
            if at + 1 >= len(message) or jumps >= JUMPS:
                return None
            after = at + 2 if after < 0 else after
            at, jumps = (n & 0x3F) << 8 | message[at + 1], jumps + 1
        elif n == 0:
            return ".".join([*labels, ""]) or ".", after if after >= 0 else at + 1
        elif n > 63 or at + 1 + n > len(message) or (size := size + n + 1) > 255:
            return None
        else:
            labels.append(message[at + 1 : at + 1 + n].decode("latin-1").replace("\\", "\\\\").replace(".", "\\."))
            at += n + 1
    return None


#: Record types and sections.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3", 51: "NSEC3PARAM", 257: "CAA"}
_DNS_CODES = {name: code for code, name in DNS_TYPES.items()}
_SECTIONS = ("qd", "an", "ns", "ar")


def _rdata(message: bytes, kind: int, at: int, end: int) -> str:
    data = message[at:end]
    word = lambda i: int.from_bytes(data[i : i + 2], "big")
    name = lambda i: (dns_name(message, at + i) or ("?", 0))[0]
    if kind == 1 and len(data) == 4 or kind == 28 and len(data) == 16:
        return str(ipaddress.ip_address(data))
    if kind in (2, 5, 12):
        return name(0)
    if kind == 15 and len(data) > 2:
        return f"{word(0)} {name(2)}"
    if kind == 33 and len(data) > 6:
        return f"{word(0)} {word(2)} {word(4)} {name(6)}"
    if kind == 16:
        parts, i = [], 0
        while i < len(data):
            parts.append(data[i + 1 : i + 1 + data[i]].decode("latin-1"))
            i += 1 + data[i]
        return "".join(parts)
    if kind == 6 and (first := dns_name(message, at)) and (second := dns_name(message, first[1])) and second[1] + 20 <= end:
        return " ".join([first[0], second[0], *(str(int.from_bytes(message[i : i + 4], "big")) for i in range(second[1], second[1] + 20, 4))])
    if (text := _secured(message, kind, at, end)) is not None:
        return text
    if kind == 257 and len(data) > 2:
        return f"{data[0]} {data[2 : 2 + data[1]].decode('latin-1')} {data[2 + data[1] :].decode('latin-1')}"
    return data.hex()


def _bitmap(data: bytes) -> str:
    """Names of the types of a bitmap of NSEC or NSEC3."""
    out, i = [], 0
    while i + 2 <= len(data):
        window, size = data[i], data[i + 1]
        for k, octet in enumerate(data[i + 2 : i + 2 + size]):
            out += [window * 256 + k * 8 + bit for bit in range(8) if octet & 0x80 >> bit]
        i += 2 + size
    return " ".join(DNS_TYPES.get(x, f"TYPE{x}") for x in out)


def _secured(message: bytes, kind: int, at: int, end: int) -> str | None:
    """The data of DNSSEC's records as text; None if it isn't such a record, or is cut off."""
    data = message[at:end]
    number = lambda i, n: int.from_bytes(data[i : i + n], "big")
    coded = lambda i: binascii.b2a_base64(data[i:], newline=False).decode()
    if kind == 43 and len(data) > 4:
        return f"{number(0, 2)} {data[2]} {data[3]} {data[4:].hex().upper()}"
    if kind == 48 and len(data) > 4:
        return f"{number(0, 2)} {data[2]} {data[3]} {coded(4)}"
    if kind == 46 and len(data) > 18 and (signer := dns_name(message, at + 18)):
        covered = DNS_TYPES.get(number(0, 2), f"TYPE{number(0, 2)}")
        return f"{covered} {data[2]} {data[3]} {number(4, 4)} {number(8, 4)} {number(12, 4)} {number(16, 2)} {signer[0]} {coded(signer[1] - at)}"
    if kind == 47 and (follower := dns_name(message, at)):
        return f"{follower[0]} {_bitmap(data[follower[1] - at :])}".rstrip()
    if kind in (50, 51) and len(data) >= 5 and len(data) >= 5 + data[4]:
        head = f"{data[0]} {data[1]} {number(2, 2)} {data[5 : 5 + data[4]].hex().upper() or '-'}"
        rest = data[5 + data[4] :]
        if kind == 51:
            return head
        if rest and len(rest) > rest[0]:
            return f"{head} {_base32(rest[1 : 1 + rest[0]])} {_bitmap(rest[1 + rest[0] :])}".rstrip()
    return None


def _base32(data: bytes) -> str:
    """Octets in the base-32 alphabet of NSEC3, without padding."""
    return base64.b32hexencode(data).decode().rstrip("=")


def _dns(message: bytes) -> Iterator[tuple]:
    if len(message) < 12:
        return
    at = 12
    for k, section in enumerate(_SECTIONS):
        for _ in range(int.from_bytes(message[4 + 2 * k : 6 + 2 * k], "big")):
            found = dns_name(message, at)
            if found is None or found[1] + (4 if k == 0 else 10) > len(message):
                return
            name, at = found
            kind, cls = (int.from_bytes(message[i : i + 2], "big") for i in (at, at + 2))
            if k == 0:
                at += 4
                yield section, name, DNS_TYPES.get(kind, str(kind)), cls, None, None
                continue
            ttl, size = int.from_bytes(message[at + 4 : at + 8], "big"), int.from_bytes(message[at + 8 : at + 10], "big")
            at += 10
            if at + size > len(message):
                return
            yield section, name, DNS_TYPES.get(kind, str(kind)), cls, ttl, _rdata(message, kind, at, at + size)
            at += size


def dns_records(message: Column | None = None) -> Column:
    """array<struct<section, name, type, class, ttl, data>> of a DNS message, or of the one that a dissected packet holds."""
    if message is None:
        at = F.col("off_DNS")
        message = F.when(at.isNotNull(), O.part(F.col("data"), at, F.col("end") - at))
    kind = _struct(section=T.StringType(), name=T.StringType(), type=T.StringType(), **{"class": T.LongType()}, ttl=T.LongType(), data=T.StringType())
    return _lists(kind, _dns)(message)


class _Writer:
    """A DNS message that is being written; names point to where their endings stand already."""

    def __init__(self, number: int, flags: int, counts: list[int]):
        self.out = bytearray(b"".join(x.to_bytes(2, "big") for x in (number, flags, *counts)))
        self.places: dict[tuple[bytes, ...], int] = {}

    def name(self, text: str, compressed: bool = True) -> None:
        labels = [re.sub(r"\\(.)", r"\1", x).encode("latin-1", "replace")[:63] for x in re.findall(r"(?:\\.|[^.\\])+", text)]
        for i in range(len(labels)):
            ending = tuple(labels[i:])
            if compressed and ending in self.places:
                self.out += (0xC000 | self.places[ending]).to_bytes(2, "big")
                return
            if len(self.out) < 0x4000:
                self.places.setdefault(ending, len(self.out))
            self.out += bytes([len(labels[i])]) + labels[i]
        self.out.append(0)

    def numbers(self, size: int, *texts: str) -> None:
        for text in texts:
            self.out += int(text).to_bytes(size, "big")

    def data(self, kind: int, text: str) -> None:
        """Record data from the text that dns_records gives; of other kinds it is hexadecimal."""
        part = text.split(" ")
        if kind in (1, 28):
            self.out += ipaddress.ip_address(text).packed
        elif kind in (2, 5, 12):
            self.name(text)
        elif kind == 15:
            self.numbers(2, part[0])
            self.name(part[1])
        elif kind == 33:
            self.numbers(2, *part[:3])
            self.name(part[3], compressed=False)
        elif kind == 16:
            raw = text.encode("latin-1", "replace")
            for i in range(0, max(1, len(raw)), 255):
                self.out += bytes([len(raw[i : i + 255])]) + raw[i : i + 255]
        elif kind == 6:
            self.name(part[0])
            self.name(part[1])
            self.numbers(4, *part[2:])
        elif kind == 43:
            self.numbers(2, part[0])
            self.numbers(1, *part[1:3])
            self.out += bytes.fromhex(part[3])
        elif kind == 47:
            self.name(part[0], compressed=False)
            self.types(part[1:])
        elif kind == 48:
            self.numbers(2, part[0])
            self.numbers(1, *part[1:3])
            self.out += binascii.a2b_base64(part[3])
        elif kind == 257:
            tag, value = part[1].encode("latin-1"), " ".join(part[2:]).encode("latin-1", "replace")
            self.out += bytes([int(part[0]), len(tag)]) + tag + value
        else:
            self.out += bytes.fromhex(text)

    def types(self, names: list[str]) -> None:
        """A bitmap of types, a window for each 256 of them."""
        codes = sorted(_DNS_CODES[n] if n in _DNS_CODES else int(n.removeprefix("TYPE")) for n in names if n)
        for window in sorted({c >> 8 for c in codes}):
            own = [c & 255 for c in codes if c >> 8 == window]
            bits = bytearray(own[-1] // 8 + 1)
            for c in own:
                bits[c // 8] |= 0x80 >> c % 8
            self.out += bytes([window, len(bits)]) + bits


def _written(rows: list[dict], number: int, flags: int) -> bytes:
    ordered = [r for section in _SECTIONS for r in rows if r["section"] == section]
    w = _Writer(number & 0xFFFF, flags & 0xFFFF, [sum(r["section"] == s for r in ordered) for s in _SECTIONS])
    for r in ordered:
        kind = _DNS_CODES[r["type"]] if r["type"] in _DNS_CODES else int(r["type"].removeprefix("TYPE"))
        w.name(r["name"])
        w.numbers(2, kind, 1 if r["class"] is None else r["class"])
        if r["section"] == "qd":
            continue
        w.numbers(4, r["ttl"] or 0)
        at = len(w.out)
        w.out += b"\0\0"
        w.data(kind, r["data"] or "")
        w.out[at : at + 2] = (len(w.out) - at - 2).to_bytes(2, "big")
    return bytes(w.out)


@F.arrow_udf(T.BinaryType())
def _dns_message(rows: pa.Array, number: pa.Array, flags: pa.Array) -> pa.Array:
    each = zip(rows.to_pylist(), number.to_pylist(), flags.to_pylist(), strict=True)
    return pa.array([None if r is None else _written(r, n or 0, f or 0) for r, n, f in each], pa.binary())


def dns_message(rows: Column, number: Column | int = 0, flags: Column | int = 0x8180) -> Column:
    """Octets of a DNS message from records as `dns_records` gives them, of sections in their order; names are compressed.

    Types are written from their texts: A, AAAA, NS, CNAME, PTR, MX, SRV, TXT, SOA, DS, NSEC, DNSKEY and CAA, others (also as TYPE123) from hexadecimal
    data. Names in SRV and NSEC aren't compressed (RFC 3597).
    """
    return _dns_message(rows, O.as_column(number).cast("bigint"), O.as_column(flags).cast("bigint"))


def dns_encoded(name: Column) -> Column:
    """Octets of a name, with or without a final dot, uncompressed; labels are cut at 63 octets."""
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    one = lambda x: F.concat(O.octets(F.least(F.octet_length(x), F.lit(63)), 1), O.part(F.encode(x, "UTF-8"), 0, 63))
    return F.concat(F.aggregate(F.transform(labels, one), F.lit(b""), lambda a, x: F.concat(a, x)), F.lit(b"\0"))


def _oid(b: bytes) -> str:
    parts, value = [], 0
    for x in b:
        value = value << 7 | x & 0x7F
        if x < 0x80:
            first = min(value // 40, 2)
            parts += [value] if parts else [first, value - 40 * first]
            value = 0
    return ".".join(map(str, parts))


def _ber(b: bytes) -> Iterator[tuple]:
    stack = [(0, len(b), 0)]
    while stack:
        at, end, depth = stack.pop()
        if at + 2 > end:
            continue
        tag, n, begin = b[at], b[at + 1], at + 2
        if tag & 0x1F == 0x1F or n == 0x80 or (n > 0x80 and (n & 0x7F > 4 or begin + (n & 0x7F) > end)):
            continue  # long tags, indefinite lengths and lengths over four octets aren't read
        if n > 0x80:
            begin, n = begin + (n & 0x7F), int.from_bytes(b[begin : begin + (n & 0x7F)], "big")
        if begin + n > end:
            continue
        value = b[begin : begin + n]
        text = str(int.from_bytes(value, "big", signed=True)) if tag in (2, 10) and 0 < n <= 8 else _oid(value) if tag == 6 else value.decode("latin-1") if tag in (4, 12, 19, 22) else None
        yield depth, tag, at, n, text
        stack.append((begin + n, end, depth))
        if tag & 0x20 and depth < 32:
            stack.append((begin, begin + n, depth + 1))


def ber_values(data: Column) -> Column:
    """array<struct<depth, tag, at, length, text>> of BER values, constructed ones before what they hold; text of integers, OIDs and strings."""
    kind = _struct(depth=T.IntegerType(), tag=T.LongType(), at=T.IntegerType(), length=T.LongType(), text=T.StringType())
    return _lists(kind, _ber)(data)


def group(data: Column, start: Column, count: Column, element: Layer, end: Column | None = None) -> Column:
    """array<struct> of the fields of `element`, repeated from `start`: as many as `count` says and as are there. Native."""
    there = F.floor(((F.length(data) if end is None else end) - start) / element.least)
    n = F.greatest(F.least(count.cast("bigint"), there.cast("bigint")), F.lit(0)).cast("int")

    def one(i: Column) -> Column:
        at = start + i * element.least
        cells = []
        for name, f in element.fields.items():
            if f.kind in ("mac", "ipv6", "bytes"):
                raw = O.part(data, at + f.bit // 8, f.width // 8)
                cells.append({"mac": O.mac_text, "ipv6": O.ipv6_text, "bytes": lambda x: x}[f.kind](raw).alias(name))
            else:
                raw = O.bits(data, at, f.bit, f.width)
                cells.append((O.ipv4_text(raw) if f.kind == "ipv4" else raw).alias(name))
        return F.struct(*cells)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).when(n.isNotNull(), F.array().cast(_group_type(element)))


def _group_type(element: Layer) -> str:
    text = {"mac": "string", "ipv6": "string", "ipv4": "string", "bytes": "binary"}
    return "array<struct<" + ",".join(f"{n}:{text.get(f.kind, 'bigint')}" for n, f in element.fields.items()) + ">>"


def header_lines(block: Column) -> Column:
    """array<struct<name, value>> of the header lines of a CRLF text protocol's block; the start line has the name ''."""
    lines = F.split(F.split_part(F.decode(block, "ISO-8859-1"), F.lit("\r\n\r\n"), F.lit(1)), "\r\n")

    def one(x: Column, i: Column) -> Column:
        at = F.instr(x, ":")
        plain = (i == 0) | (at == 0)
        return F.struct(F.when(plain, F.lit("")).otherwise(F.substring(x, F.lit(1), at - 1)).alias("name"), F.when(plain, x).otherwise(F.trim(F.substring(x, at + 1, F.length(x)))).alias("value"))

    return F.transform(lines, one)
