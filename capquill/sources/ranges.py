"""Large capture files in byte ranges: many tasks read one file, and give the rows that one task would.

A range does not know where its first record begins, so reading takes two steps. `index` walks the headers of every range
from the first place that looks like the start of a record and is followed by more of them, and notes where it began,
where the first record of the next range begins, and how many packets it met. Then the seams are verified: the first range
begins after the file's header, and each other one where the one before it ended. Ranges that guessed wrong are
walked again from where they must begin, all of them at once, until the chain of a file closes. What a guess looks like
decides how often that happens, never what is read. The index is a small table (a row for each range), with the number of
each range's first packet, and what a section says about its interfaces before the range.

`CaptureSource` is the data source `capture` over an index: a partition for each range, or for several short ones, which its task
reads one after the other. Of a slice by `num` only the ranges
that hold some of it are read, `columns` leaves out what isn't asked for (such as the octets of packets), and
`count` needs the index only. gzip files are one range each, inflated as a whole.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from capquill.sources import captures as C
from capquill.sources.files import Reader, located, scratch, sizes

SPLIT = 64 << 20
#: Where ranges are short, tasks for each core that walk them, and about how many tasks read them.
TURNS, TASKS = 4, 1024
#: Records in a row that make a guess, octets that are searched at a time, and the most octets of a packet that a guess allows.
LIKELY, SEARCH, LARGEST = 6, 1 << 16, 1 << 18
#: Octets that a range reads over its end for headers that begin in it.
OVER = 4096
#: Block types of pcapng, and its byte order mark as it stands in a little-endian section.
SECTION, INTERFACE, SIMPLE, ENHANCED, LITTLE = 0x0A0D0D0A, 1, 3, 6, b"\x4d\x3c\x2b\x1a"
BLOCKS = (SECTION, INTERFACE, 2, SIMPLE, 4, 5, ENHANCED, 10, 0xBAD, 0x40000BAD)
RANGES = "path string, part bigint, lo bigint, hi bigint, size bigint, start bigint, byte_order string"
WALKS = "path string, part bigint, lo bigint, hi bigint, size bigint, guess boolean, kind string, start bigint, byte_order string, stop bigint, order_after string, ended boolean, packets bigint, needs string, renewed boolean, opened binary, header binary"
INDEX = "path string, part bigint, kind string, start bigint, stop bigint, num bigint, packets bigint, preamble binary, begins bigint, order_then string"


def kind_of(head: bytes) -> str:
    """gz, pcap, pcapng or erf, by the first octets of a file."""
    if head[:2] == b"\x1f\x8b":
        return "gz"
    return "pcap" if head[:4] in C.PCAP_MAGIC else "pcapng" if head[:4] == C.PCAPNG_MAGIC else "erf"


class _Window:
    """A part of a file in memory, and the rest of it where that is needed."""

    def __init__(self, file: Reader, lo: int, hi: int):
        self.file, self.lo = file, lo
        self.held = file.part(lo, hi - lo + OVER)

    def get(self, at: int, n: int) -> bytes:
        i = at - self.lo
        return self.held[i : i + n] if 0 <= i and i + n <= len(self.held) else self.file.part(at, n)


@dataclass
class _Record:
    length: int
    #: Packets in it; of pcapng, the interfaces that must be known before it for the packet to count.
    packets: int = 1
    interface: int | None = None
    opens: bytes | None = None
    order: str | None = None


def _pcap_record(w: _Window, at: int, order: str) -> _Record | None:
    head = w.get(at, 16)
    if len(head) < 16:
        return None
    length = 16 + struct.unpack_from(order + "I", head, 8)[0]
    return _Record(length) if at + length <= w.file.size else None


def _pcapng_record(w: _Window, at: int, order: str) -> _Record | None:
    head = w.get(at, 32)
    if len(head) < 12:
        return None
    if section := head[:4] == C.PCAPNG_MAGIC:
        order = "<" if head[8:12] == LITTLE else ">"
    kind, length = struct.unpack_from(order + "II", head)
    sound = length >= 12 and length % 4 == 0 and at + length <= w.file.size
    if not sound or w.get(at + length - 4, 4) != struct.pack(order + "I", length):
        return None
    if section or kind == INTERFACE and length >= 20:
        return _Record(length, 0, None, w.get(at, length), order if section else None)
    if kind == ENHANCED and length >= 32:
        interface, _, _, caplen = struct.unpack_from(order + "4I", head, 8)
        return _Record(length, int(28 + caplen <= length - 4), interface)
    return _Record(length, int(kind == SIMPLE and length >= 16), 0)


def _erf_record(w: _Window, at: int, _: str) -> _Record | None:
    head = w.get(at, 16)
    length = struct.unpack_from(">H", head, 10)[0] if len(head) == 16 else 0
    if length < 16 or at + length > w.file.size:
        return None
    return _Record(length, sum(1 for _ in C._erf(w.get(at, length))))


RECORD = {"pcap": _pcap_record, "pcapng": _pcapng_record, "erf": _erf_record}
PACKETS = {"pcap": C._pcap, "pcapng": C._pcapng, "erf": C._erf}


def _words(octets: np.ndarray, order: str, at: int, n: int = 4) -> np.ndarray:
    """The integer of n octets at a distance from each place of an array."""
    places = range(n) if order == ">" else range(n - 1, -1, -1)
    count = len(octets) - 15
    value = np.zeros(count, np.int64)
    for i in places:
        value = value << 8 | octets[at + i : at + i + count]
    return value


def _plausible(kind: str, raw: bytes, order: str, unit: int) -> np.ndarray:
    """Places of raw at which a record may begin; 15 octets at its end aren't looked at."""
    octets = np.frombuffer(raw, np.uint8).astype(np.int64)
    if len(octets) < 16:
        return np.empty(0, np.int64)
    word = lambda at: _words(octets, order, at)
    if kind == "pcap":
        size, wire = word(8), word(12)
        return np.flatnonzero((word(4) < 1_000_000_000 // unit) & (size <= LARGEST) & (size <= wire) & (wire < 1 << 24))
    if kind == "pcapng":
        return np.flatnonzero(np.isin(word(0), BLOCKS) & (word(4) % 4 == 0) & (word(4) >= 12))
    length, wire = _words(octets, ">", 10, 2), _words(octets, ">", 14, 2)
    return np.flatnonzero((octets[8 : len(octets) - 7] & 127 == 2) & (length >= 18) & (wire <= length + 65535))


def _guess(w: _Window, kind: str, lo: int, hi: int, orders: Sequence[str], unit: int) -> tuple[int, str] | None:
    """The first place in a range from which records follow one another."""

    def follows(at: int, order: str) -> bool:
        for _ in range(LIKELY):
            if at == w.file.size:
                return True
            record = RECORD[kind](w, at, order)
            looks = _plausible(kind, w.get(at, 16), record and record.order or order, unit) if record else ()
            if not len(looks):
                return False
            at, order = at + record.length, record.order or order
        return True

    for base in range(lo, hi, SEARCH):
        raw = w.get(base, min(SEARCH, hi - base) + 15)
        for order in orders:
            for place in _plausible(kind, raw, order, unit):
                at = base + int(place)
                if (kind != "pcapng" or at % 4 == 0) and follows(at, order):
                    return at, order
    return None


def _walk(path: str, part: int, lo: int, hi: int, size: int, start: int, byte_order: str) -> dict:
    """A range walked from a given start, or from a guess (start -1)."""
    row = {"path": path, "part": part, "lo": lo, "hi": hi, "size": size, "guess": start < 0}
    row |= {"stop": -1, "ended": False, "packets": 0, "needs": "{}", "renewed": False, "opened": b""}
    with Reader(path) as file:
        header = file.part(0, 24)
        kind = kind_of(header)
        order, unit = C.PCAP_MAGIC[header[:4]] if kind == "pcap" else ("<" if header[8:12] == LITTLE else ">", 1)
        row |= {"kind": kind, "header": header if kind == "pcap" else b""}
        if kind == "gz":
            count = sum(1 for _ in C.records(file.part(0, size))) if lo == 0 else 0
            return row | {"start": 0 if lo == 0 else -1, "byte_order": "", "order_after": "", "stop": size, "packets": count}
        w = _Window(file, lo, hi)
        if start < 0 and lo == 0:
            start = 24 if kind == "pcap" else 0
        elif start < 0:
            found = _guess(w, kind, lo, hi, "<>" if kind == "pcapng" and order == "<" else "><" if kind == "pcapng" else order, unit)
            start, order = found or (-1, "")
        else:
            order = byte_order
        row |= {"start": start, "byte_order": order}
        at, links, needs, opened = start, 0, Counter(), []
        while 0 <= at < hi and not row["ended"]:
            record = RECORD[kind](w, at, order)
            if record is None:
                row["ended"] = True
                break
            if record.opens is not None:
                if record.order:
                    order, links, opened = record.order, 0, []
                    row["renewed"] = True
                else:
                    links += 1
                opened.append(record.opens)
            elif record.packets and record.interface is not None and record.interface >= links:
                if not row["renewed"]:
                    needs[record.interface - links] += 1
            else:
                row["packets"] += record.packets
            at += record.length
        return row | {"stop": at, "order_after": order, "needs": json.dumps(needs), "opened": b"".join(opened)}


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in WALKS.split(", ")]
    for batch in batches:
        yield pd.DataFrame([_walk(*row) for row in batch.itertuples(index=False)], columns=names)


def _interfaces(preamble: bytes) -> int:
    """Interfaces that a section's first blocks describe."""
    order, at, n = "<" if preamble[8:12] == LITTLE else ">", 0, 0
    while at + 12 <= len(preamble):
        kind, length = struct.unpack_from(order + "II", preamble, at)
        n += kind == INTERFACE
        at += length
    return n


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ranges of a file if its chain closes, else those that are to be walked again (begins, order_then)."""
    walks = {(r.part, r.start, r.byte_order): r for r in pdf.itertuples(index=False)}
    guesses = {r.part: r for r in pdf[pdf["guess"]].itertuples(index=False)}
    first = guesses[0]
    path, at, order, num, preamble = first.path, first.start, first.byte_order, 0, bytes(first.header)
    closed, again = [], []
    for part in range(len(guesses)):
        guess = guesses[part]
        if at >= guess.hi or guess.kind == "gz" and part:
            continue
        row = walks.get((part, at, order))
        if row is None:
            again.append((path, part, guess.kind, -1, -1, -1, -1, b"", at, order))
            row = guess
            if row.start < 0:
                break
        packets = row.packets + sum(n for need, n in json.loads(row.needs).items() if int(need) < _interfaces(preamble))
        closed.append((path, part, row.kind, row.start, row.stop, num, packets, preamble, -1, ""))
        num += packets
        preamble = bytes(row.opened) if row.renewed else preamble + bytes(row.opened)
        at, order = row.stop, row.order_after
        if row.ended:
            break
    return pd.DataFrame(again or closed, columns=[c.split(" ")[0] for c in INDEX.split(", ")])


def _tasks(spark: SparkSession, n: int, octets: int) -> int:
    """Tasks for n ranges: `TURNS` for each core, more if each would have over `SPLIT` octets, and none without a range."""
    return max(1, min(n, 10_000, max(TURNS * spark.sparkContext.defaultParallelism, -(-octets // SPLIT))))


def _spread(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "path", "part")


def index(spark: SparkSession, path: str, split: int = SPLIT, pattern: str | None = None, folder: str | None = None) -> str:
    """Index the capture files under a path; the folder of the index, a Parquet table, which may be kept for later reads."""
    folder = folder or scratch(spark, "captures")
    rows = [(p, k, k * split, min(size, (k + 1) * split), size, -1, "") for p, size in sizes(path, pattern) for k in range(-(-size // split))]
    _spread(spark.createDataFrame(rows, RANGES), _tasks(spark, len(rows), sum(r[3] - r[2] for r in rows))).mapInPandas(_walks, WALKS).write.parquet(f"{folder}/walks/turn=0")
    turn = 0
    while True:
        walks = spark.read.schema(WALKS).parquet(*[f"{folder}/walks/turn={k}" for k in range(turn + 1)])
        chain = walks.groupBy("path").applyInPandas(_chain, INDEX)
        chain.write.mode("overwrite").parquet(f"{folder}/index")
        again = spark.read.schema(INDEX).parquet(f"{folder}/index").where("begins >= 0")
        count = again.count()
        if not count:
            return f"{folder}/index"
        turn += 1
        places = walks.where("guess").select("path", "part", "lo", "hi", "size")
        wanted = again.join(places, ["path", "part"]).select("path", "part", "lo", "hi", "size", F.col("begins").alias("start"), F.col("order_then").alias("byte_order"))
        _spread(wanted, _tasks(spark, count, count * split)).mapInPandas(_walks, WALKS).write.parquet(f"{folder}/walks/turn={turn}")


@dataclass
class Range:
    path: str
    kind: str
    start: int
    stop: int
    num: int
    preamble: bytes


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Range]


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.index, self.names = options["path"], schema.names
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[Ranges]:
        store, place = located(self.index)
        rows = pq.read_table(place, filesystem=store).to_pylist()
        kept = [r for r in rows if r["packets"] and r["num"] <= self.last and r["num"] + r["packets"] > self.first]
        share, held = min(SPLIT, sum(r["stop"] - r["start"] for r in kept) / TASKS), SPLIT
        out: list[Ranges] = []
        for r in kept:
            size = r["stop"] - r["start"]
            if held + size > share:
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append(Range(r["path"], r["kind"], r["start"], r["stop"], r["num"], r["preamble"]))
            held += size
        return out

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges if partition else ():  # without any partition Spark asks once all the same
            yield from self.range(one)

    def range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        wanted = pa.schema([(n, TYPES[n]) for n in self.names])
        with Reader(partition.path) as file:
            raw = file.part(partition.start, partition.stop - partition.start)
        if partition.kind == "gz":
            raw = gzip.decompress(raw)
        walk = PACKETS[kind_of(raw) if partition.kind == "gz" else partition.kind]
        held = []
        for num, (ts, wirelen, link, note, data) in enumerate(walk(partition.preamble + raw), partition.num):
            if not self.first <= num <= self.last:
                continue
            held.append((partition.path, num, ts, ts / 1e9, len(data), wirelen, link, note, data))
            if len(held) == C._BATCH:
                yield _batch(held, wanted)
                held = []
        if held:
            yield _batch(held, wanted)


TYPES = {"capture": pa.string(), "num": pa.int64(), "ts_ns": pa.int64(), "time": pa.float64(), "caplen": pa.int64(), "wirelen": pa.int64(), "linktype": pa.int32(), "comment": pa.string(), "data": pa.binary()}


def _batch(rows: list[tuple], wanted: pa.Schema) -> pa.RecordBatch:
    columns = dict(zip(TYPES, zip(*rows, strict=True), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], TYPES[n]) for n in wanted.names], schema=wanted)


class CaptureSource(DataSource):
    """spark.read.format("capture").option("columns", "num,time").option("first", 1000).load(index)

    The ranges that hold none of the packets from number `first` to `last` aren't read. (pushFilters would do it for any filter
    on num, but in this version of Spark one query's filters stay with the relation and cut off what another reads.)
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        kinds = dict(c.split(" ") for c in C.SCHEMA.split(", "))
        wanted = self.options.get("columns")
        return ", ".join(f"{n} {kinds[n]}" for n in (wanted.split(",") if wanted else kinds))

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(self.options, schema)


def read(spark: SparkSession, path: str, split: int = SPLIT, columns: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    """The packets of all capture files under a path, each file by many tasks."""
    return read_index(spark, index(spark, path, split, pattern), columns)


def read_index(spark: SparkSession, folder: str, columns: Sequence[str] = (), first: int = 0, last: int | None = None) -> DataFrame:
    """The packets, of the numbers first to last, of captures that were indexed before; columns: just these, of those of captures.SCHEMA.

    A task reads a range, or as many as make up `SPLIT` octets or its share of the octets as one of `TASKS`.
    """
    spark.dataSource.register(CaptureSource)
    source = spark.read.format("capture").option("first", first)
    source = source.option("columns", ",".join(columns)) if columns else source
    return (source if last is None else source.option("last", last)).load(folder)


def count(spark: SparkSession, folder: str) -> DataFrame:
    """path, packets of each indexed capture, without reading a packet."""
    return spark.read.schema(INDEX).parquet(folder).groupBy("path").agg(F.sum("packets").alias("packets"))
