"""BER and DER values by a schema: the schema's tree is walked together with the octets, to nested columns.

A schema is built of the types here; `decoded` makes a column of its Spark type. Fields of a sequence are told by their
tags, so optional ones may be missing, and elements that no field claims are passed over. Long tags, lengths of any
form and indefinite lengths are read. A value that is cut off, or isn't what the schema says, is null, and what stands
before it stays. `tree` joins object identifiers to the names of their longest known prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Nesting that is followed.
DEEPEST = 32
#: Tags of universal types.
BOOLEAN, INTEGER, OCTETS, NULL, OID, ENUMERATED, UTF8, SEQUENCE, SET = 1, 2, 4, 5, 6, 10, 12, 0x30, 0x31


def element(b: bytes, at: int, end: int, depth: int = 0) -> tuple[int, int, int, int] | None:
    """(tag, begin of the value, its end, where the next element begins) of the element at an offset; None if it is cut off or wrong."""
    if at >= end or depth > DEEPEST:
        return None
    tag, i = b[at], at + 1
    if tag & 0x1F == 0x1F:  # a long tag: its number follows, seven bits an octet
        while i < end and i - at <= 4 and b[i] & 0x80:
            tag, i = tag << 8 | b[i], i + 1
        if i >= end or i - at > 4:
            return None
        tag, i = tag << 8 | b[i], i + 1
    if i >= end:
        return None
    n, i = b[i], i + 1
    if n == 0x80:  # up to two octets of zero
        if not b[at] & 0x20:
            return None
        stop = i
        while b[stop : stop + 2] != b"\0\0" or stop + 2 > end:
            inner = element(b, stop, end, depth + 1)
            if inner is None:
                return None
            stop = inner[3]
        return tag, i, stop, stop + 2
    if n > 0x80:
        size = n & 0x7F
        if size > 8 or i + size > end:
            return None
        n, i = int.from_bytes(b[i : i + size], "big"), i + size
    return (tag, i, i + n, i + n) if i + n <= end else None


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while (e := element(b, at, end)) is not None:
        yield e[:3]
        at = e[3]


def oid_text(b: bytes) -> str | None:
    parts, value = [], 0
    for x in b:
        value = value << 7 | x & 0x7F
        if x < 0x80:
            first = min(value // 40, 2)
            parts += [value] if parts else [first, value - 40 * first]
            value = 0
    return ".".join(map(str, parts)) if parts and not b[-1] & 0x80 else None


@dataclass(frozen=True)
class Simple:
    """A value without parts; tags: those under which it may stand (implicit tags, for instance)."""

    tags: tuple[int, ...]
    ddl: str
    kind: str

    def read(self, tag: int, b: bytes, begin: int, end: int, depth: int) -> object:
        value = b[begin:end]
        if self.kind == "integer":
            return int.from_bytes(value, "big", signed=True) if 0 < len(value) <= 8 else None
        if self.kind == "unsigned":
            number = int.from_bytes(value, "big")
            return number if value and number < 1 << 63 else None
        return {"octets": lambda: value, "text": lambda: value.decode("utf-8", "replace"), "oid": lambda: oid_text(value), "boolean": lambda: any(value)}[self.kind]()


@dataclass(frozen=True)
class Any:
    """Whatever stands there: its tag, and its octets; of numbers, identifiers and texts also a text."""

    tags: tuple[int, ...] = ()
    ddl: str = "struct<tag:bigint,octets:binary,text:string>"

    def read(self, tag: int, b: bytes, begin: int, end: int, depth: int) -> object:
        value, text = b[begin:end], None
        if tag in (INTEGER, ENUMERATED) and 0 < len(value) <= 8:
            text = str(int.from_bytes(value, "big", signed=True))
        elif tag == OID:
            text = oid_text(value)
        elif tag in (OCTETS, UTF8, 19, 22):
            text = value.decode("utf-8", "replace")
        elif tag & 0xC0 == 0x40 and not tag & 0x20 and 0 < len(value) <= 8:  # application types, such as counters and ticks
            text = str(int.from_bytes(value, "big"))
        return {"tag": tag, "octets": value, "text": text}


@dataclass(frozen=True)
class Sequence:
    """Named parts, each of which may be missing."""

    fields: dict[str, object] = field(hash=False)
    tags: tuple[int, ...] = (SEQUENCE,)

    @property
    def ddl(self) -> str:
        return "struct<" + ",".join(f"{n}:{t.ddl}" for n, t in self.fields.items()) + ">"

    def read(self, tag: int, b: bytes, begin: int, end: int, depth: int) -> object:
        out, names = dict.fromkeys(self.fields), list(self.fields)
        for part, start, stop in elements(b, begin, end):
            wanted = next((i for i, n in enumerate(names) if not self.fields[n].tags or part in self.fields[n].tags), None)
            if wanted is None:
                continue
            name = names[wanted]
            out[name] = self.fields[name].read(part, b, start, stop, depth + 1) if depth < DEEPEST else None
            names = names[wanted + 1 :]
        return out


@dataclass(frozen=True)
class SequenceOf:
    """Any number of parts of one type; parts of another tag are passed over."""

    of: object
    tags: tuple[int, ...] = (SEQUENCE, SET)

    @property
    def ddl(self) -> str:
        return f"array<{self.of.ddl}>"

    def read(self, tag: int, b: bytes, begin: int, end: int, depth: int) -> object:
        inside = elements(b, begin, end) if depth < DEEPEST else ()
        return [self.of.read(part, b, start, stop, depth + 1) for part, start, stop in inside if not self.of.tags or part in self.of.tags]


@dataclass(frozen=True)
class Choice:
    """One of several named types, told by its tag: a struct in which the others are null."""

    options: dict[str, object] = field(hash=False)

    @property
    def tags(self) -> tuple[int, ...]:
        return tuple(t for o in self.options.values() for t in o.tags)

    @property
    def ddl(self) -> str:
        return "struct<" + ",".join(f"{n}:{t.ddl}" for n, t in self.options.items()) + ">"

    def read(self, tag: int, b: bytes, begin: int, end: int, depth: int) -> object:
        return {n: t.read(tag, b, begin, end, depth) if tag in t.tags else None for n, t in self.options.items()}


def integer(*tags: int) -> Simple:
    return Simple(tags or (INTEGER, ENUMERATED), "bigint", "integer")


def unsigned(*tags: int) -> Simple:
    return Simple(tags, "bigint", "unsigned")


def octets(*tags: int) -> Simple:
    return Simple(tags or (OCTETS,), "binary", "octets")


def text(*tags: int) -> Simple:
    return Simple(tags or (OCTETS, UTF8, 19, 22), "string", "text")


def oid(*tags: int) -> Simple:
    return Simple(tags or (OID,), "string", "oid")


def boolean(*tags: int) -> Simple:
    return Simple(tags or (BOOLEAN,), "boolean", "boolean")


def decoded(data: Column, schema: Sequence | SequenceOf | Choice | Simple | Any) -> Column:
    """The first element of octets as the schema says; null where there is none of its tag."""
    kind = DataType.fromDDL(schema.ddl)

    def run(values: pa.Array) -> pa.Array:
        out = []
        for b in values.to_pylist():
            e = element(b, 0, len(b)) if b else None
            out.append(schema.read(e[0], b, e[1], e[2], 0) if e and (not schema.tags or e[0] in schema.tags) else None)
        return pa.array(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(data)


#: SNMP messages (RFC 1157, RFC 3416); what kind a message is tells the tag of its PDU.
SNMP_KINDS = {"get": 0xA0, "get_next": 0xA1, "response": 0xA2, "set": 0xA3, "get_bulk": 0xA5, "inform": 0xA6, "trap": 0xA7}
_BINDINGS = SequenceOf(Sequence({"oid": oid(), "value": Any()}), tags=(SEQUENCE,))
_PDU = {"id": integer(), "status": integer(), "index": integer(), "bindings": _BINDINGS}
SNMP = Sequence({"version": integer(), "community": text(), "pdu": Choice({name: Sequence(_PDU, tags=(tag,)) for name, tag in SNMP_KINDS.items()})})


def snmp_bindings(df: DataFrame, message: Column) -> DataFrame:
    """df with version, community, kind, id, oid and value (its text): a row for each binding of an SNMP message; other messages give none."""
    d = df.withColumn("_m", decoded(message, SNMP))
    pdu, kind = F.coalesce(*[F.col(f"_m.pdu.{n}") for n in SNMP_KINDS]), F.coalesce(*[F.when(F.col(f"_m.pdu.{n}").isNotNull(), n) for n in SNMP_KINDS])
    d = d.select(*df.columns, "_m.version", "_m.community", kind.alias("kind"), pdu["id"].alias("id"), F.explode(pdu["bindings"]).alias("_b"))
    return d.select(*df.columns, "version", "community", "kind", "id", "_b.oid", F.col("_b.value.text").alias("value"))


def tree(df: DataFrame, names: DataFrame, by: str = "oid") -> DataFrame:
    """df with name and rest: the name of the longest known prefix of an object identifier, and what follows it; null without one.

    names: oid, name. An equi-join on each of the prefixes, of which an identifier has as many as parts.
    """
    parts = F.split(F.col(by), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    each = df.select(by).distinct().where(F.col(by).isNotNull()).withColumn("prefix", F.explode(prefixes))
    known = each.join(names.select(F.col("oid").alias("prefix"), "name"), "prefix")
    best = known.groupBy(by).agg(F.max_by(F.struct("name", "prefix"), F.length("prefix")).alias("best"))
    rest = F.substring(F.col(by), F.length("best.prefix") + 2, F.length(by))
    return df.join(best, by, "left").select(*df.columns, F.col("best.name").alias("name"), rest.alias("rest"))
