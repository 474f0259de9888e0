"""Capture files: pcap, pcapng and ERF (also gzipped) in and out. Here one task reads one file; `ranges` splits files."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.functions import octets as O
from capquill.sources.files import located

SCHEMA = "capture string, num bigint, ts_ns bigint, time double, caplen bigint, wirelen bigint, linktype int, comment string, data binary"
#: File magics (octets as they stand in the file) with byte order and nanoseconds per unit.
PCAP_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
_BATCH = 4096


def _pcap(raw: bytes) -> Iterator[tuple]:
    order, unit = PCAP_MAGIC[raw[:4]]
    link = struct.unpack_from(order + "I", raw, 20)[0] & 0xFFFF if len(raw) >= 24 else 1
    at = 24
    while at + 16 <= len(raw):
        sec, part, caplen, wirelen = struct.unpack_from(order + "4I", raw, at)
        if at + 16 + caplen > len(raw):
            return
        yield sec * 1_000_000_000 + part * unit, wirelen, link, None, raw[at + 16 : at + 16 + caplen]
        at += 16 + caplen


def _options(raw: bytes, at: int, end: int, order: str) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", raw, at)
        if code == 0 or at + 4 + size > end:
            break
        out[code] = raw[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4
    return out


def _pcapng(raw: bytes) -> Iterator[tuple]:
    order, links, at = "<", [], 0
    while at + 12 <= len(raw):
        if raw[at : at + 4] == PCAPNG_MAGIC:
            order, links = "<" if raw[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", []
        kind, size = struct.unpack_from(order + "II", raw, at)
        end = at + size
        if size < 12 or size % 4 or end > len(raw) or struct.unpack_from(order + "I", raw, end - 4)[0] != size:
            return
        if kind == 1 and size >= 20:
            tsresol = _options(raw, at + 16, end - 4, order).get(9, b"\x06")[0]
            units = 2 ** (tsresol & 127) if tsresol & 128 else 10 ** (tsresol & 127)
            links.append((struct.unpack_from(order + "H", raw, at + 8)[0], units))
        elif kind == 6 and size >= 32:
            of, high, low, caplen, wirelen = struct.unpack_from(order + "5I", raw, at + 8)
            if of < len(links) and at + 28 + caplen <= end - 4:
                link, units = links[of]
                note = _options(raw, at + 28 + (caplen + 3) // 4 * 4, end - 4, order).get(1)
                yield ((high << 32) + low) * 1_000_000_000 // units, wirelen, link, note and note.decode("utf-8", "replace"), raw[at + 28 : at + 28 + caplen]
        elif kind == 3 and links and size >= 16:
            wirelen = struct.unpack_from(order + "I", raw, at + 8)[0]
            yield 0, wirelen, links[0][0], None, raw[at + 12 : min(at + 12 + wirelen, end - 4)]
        at = end


def _erf(raw: bytes) -> Iterator[tuple]:
    at = 0
    while at + 16 <= len(raw):
        part, sec, kind, _, size, _, wirelen = struct.unpack_from("<II", raw, at) + struct.unpack_from(">BBHHH", raw, at + 8)
        if size < 16 or at + size > len(raw):
            return
        head = at + 16
        more = kind & 128
        while more and head + 8 <= at + size:  # extension headers
            more, head = raw[head] & 128, head + 8
        if kind & 127 == 2 and head + 2 <= at + size:
            yield sec * 1_000_000_000 + (part * 1_000_000_000 >> 32), wirelen, 1, None, raw[head + 2 : head + 2 + min(wirelen, at + size - head - 2)]
        at += size


def records(raw: bytes) -> Iterator[tuple]:
    """(ts_ns, wirelen, linktype, comment, data) of the content of a file, told apart by its magic."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    walk = _pcap if raw[:4] in PCAP_MAGIC else _pcapng if raw[:4] == PCAPNG_MAGIC else _erf
    return walk(raw)


def read(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SCHEMA of all packets of the files under a path; num counts within each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                held = []
                for num, (ts, wirelen, link, note, data) in enumerate(records(raw)):
                    held.append((name, num, ts, ts / 1e9, len(data), wirelen, link, note, data))
                    if len(held) == _BATCH:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _little(value: Column, n: int) -> Column:
    """An integer as n little-endian octets."""
    return F.concat(*[O.part(O.octets(value, n), n - 1 - i, 1) for i in range(n)])


def _quotient(value: Column, by: int) -> Column:
    """Integer division of non-negative numbers, without a double's rounding."""
    return F.round((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("bigint")


def _nanoseconds(df: DataFrame) -> Column:
    return F.col("ts_ns") if "ts_ns" in df.columns else F.round(F.col("time") * 1_000_000_000).cast("bigint")


def pcap_header(linktype: int = 1, nanoseconds: bool = False) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B23C4D if nanoseconds else 0xA1B2C3D4, 2, 4, 0, 0, 262144, linktype)


def _sizes() -> tuple[Column, Column]:
    size = F.length("data").cast("bigint")
    return size, F.greatest(F.coalesce("wirelen", size), size)


def pcap_record(ts_ns: Column, nanoseconds: bool = False) -> Column:
    """A packet as a record of a little-endian pcap file, by native expressions; time below the unit is cut off."""
    size, wire = _sizes()
    part = F.pmod(ts_ns, F.lit(1_000_000_000))
    return F.concat(_little(_quotient(ts_ns, 1_000_000_000), 4), _little(part if nanoseconds else F.floor(part / 1000), 4), _little(size, 4), _little(wire, 4), F.col("data"))


def pcapng_header(linktype: int = 1) -> bytes:
    """A section and an interface whose times are in nanoseconds."""
    section = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    return section + struct.pack("<IIHHIHHB3xHHI", 1, 32, linktype, 0, 0, 9, 1, 9, 0, 0, 32)


def pcapng_record(ts_ns: Column) -> Column:
    """A packet as an enhanced packet block."""
    size, wire = _sizes()
    pad = F.pmod(-size, F.lit(4))
    total = _little(32 + size + pad, 4)
    high, low = F.shiftright(ts_ns, 32), ts_ns.bitwiseAND((1 << 32) - 1)
    return F.concat(_little(F.lit(6), 4), total, F.lit(b"\0\0\0\0"), _little(high, 4), _little(low, 4), _little(size, 4), _little(wire, 4), F.col("data"), O.part(F.lit(b"\0\0\0"), 0, pad), total)


def erf_record(ts_ns: Column) -> Column:
    """A packet as an Ethernet record of ERF; its times have 32 bits below the second."""
    size, wire = _sizes()
    part = _quotient(F.pmod(ts_ns, F.lit(1_000_000_000)) * F.lit(1 << 32) + 999_999_999, 1_000_000_000)
    return F.concat(_little(part, 4), _little(_quotient(ts_ns, 1_000_000_000), 4), F.unhex(F.lit("0204")), O.octets(size + 18, 2), F.lit(b"\0\0"), O.octets(wire, 2), F.lit(b"\0\0"), F.col("data"))


def write(df: DataFrame, folder: str, linktype: int = 1, kind: str = "pcap", compressed: bool = False) -> DataFrame:
    """Write one file for each partition into a folder (a path or URI that all executors reach); (path, packets) of the files.

    kind: pcap, pcap_ns (with nanoseconds), pcapng or erf; compressed: as gzip. Times are those of ts_ns, else of time. A packet without
    data has no octets. A file gets its final name when it is whole, so that a task that is run again leaves no half file.
    """
    ts = _nanoseconds(df)
    heads = {"pcap": pcap_header(linktype), "pcap_ns": pcap_header(linktype, True), "pcapng": pcapng_header(linktype), "erf": b""}
    records_of = {"pcap": lambda: pcap_record(ts), "pcap_ns": lambda: pcap_record(ts, True), "pcapng": lambda: pcapng_record(ts), "erf": lambda: erf_record(ts)}
    head, suffix = heads[kind], kind.removesuffix("_ns") + ".gz" * compressed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, place = located(folder)
        store.create_dir(place, recursive=True)
        name = f"part-{context.partitionId():05d}.{suffix}"
        part = f"{place}/.{name}.{context.taskAttemptId()}"
        n = 0
        with store.open_output_stream(part, compression="gzip" if compressed else None) as f:
            f.write(head)
            for b in batches:
                f.write(b"".join(b["record"]))
                n += len(b)
        store.move(part, f"{place}/{name}")
        yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "packets": [n]})

    filled = df.withColumn("data", F.coalesce("data", F.lit(b"")))
    return filled.select(records_of[kind]().alias("record")).mapInPandas(run, "path string, packets bigint")
