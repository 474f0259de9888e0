"""Fragmentation, defragmentation and TCP streams.

Streams are put together in blocks of `BLOCK` octets of their direction, so that no task holds a whole long
stream: a segment goes to each block that it touches, and within a block the first writer of an octet wins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from capquill.functions import octets as O
from capquill.operators.dissect import layer_column, payload
from capquill.operators.flows import NUMBERS, carried, decoded, of_capture, sequence_line
from capquill.operators.layers import LAYERS

BLOCK = 1 << 20
#: Octets of an IPv4 datagram at most, and fragments of one that are held.
OCTETS, FRAGMENTS = 65535, 8192
#: Octets in which the head of an HTTP message has to end.
HEAD = 64 << 10
#: An empty line, whatever ends it.
HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Octets of a TLS record at most.
RECORD = (1 << 14) + 2048


@F.arrow_udf(BinaryType())
def _copied_options(data: pa.Array, at: pa.Array, body: pa.Array) -> pa.Array:
    """The options of an IPv4 header that have the copy bit, padded to units of four octets."""
    out = []
    for frame, start, stop in zip(data.to_pylist(), at.to_pylist(), body.to_pylist(), strict=True):
        options, kept, i = frame[start + 20 : stop], b"", 0
        while i < len(options) and options[i] != 0:
            size = 1 if options[i] == 1 else options[i + 1] if i + 1 < len(options) else 0
            if size < 1 or options[i] != 1 and size < 2 or i + size > len(options):
                break  # what follows can't be told apart
            if options[i] & 0x80:
                kept += options[i : i + size]
            i += size
        out.append(kept + bytes(-len(kept) % 4))
    return pa.array(out, pa.binary())


def fragment(df: DataFrame, size: int = 1480) -> DataFrame:
    """num, piece, data: IPv4 datagrams in fragments with payloads of at most `size` octets, header checksums renewed.

    Datagrams with DF, or that fit, stay as they are. The first fragment has all options, the others those that are to be copied (RFC 791).
    """
    unit = size // 8 * 8
    d = decoded(df, (), ["off_IP"])[0].where(F.col("off_IP").isNotNull())
    at, data = F.col("off_IP"), F.col("data")
    head = O.bits(data, at, 4, 4) * 4
    end = F.least(F.length(data), at + F.greatest(O.be(data, at + 2, 2), head)).cast("int").alias("end")
    d = d.select("num", "data", at.cast("int").alias("at"), (at + head).cast("int").alias("body"), end, O.be(data, at + 6, 2).alias("flags"))
    whole = (F.col("end") - F.col("body") <= size) | (F.col("flags").bitwiseAND(0x4000) != 0)
    count = F.when(whole, 1).otherwise(F.ceil((F.col("end") - F.col("body")) / unit)).cast("int")
    d = d.withColumn("pieces", count).withColumn("options", O.part(data, F.col("at") + 20, F.col("body") - F.col("at") - 20))
    with_options = (F.col("pieces") > 1) & (F.length("options") > 0)
    d = d.withColumn("copied", F.when(with_options, _copied_options("data", "at", "body")).otherwise(F.lit(b"")))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    d = d.withColumn("own", F.when(F.col("piece") == 0, F.col("options")).otherwise(F.col("copied")))
    body = O.part(data, F.col("body") + F.col("piece") * unit, F.least(F.lit(unit), F.col("end") - F.col("body") - F.col("piece") * unit))
    flags = (F.col("flags") + F.col("piece") * (unit // 8)).bitwiseOR(F.when(F.col("piece") < F.col("pieces") - 1, 0x2000).otherwise(0))
    length = 20 + F.length("own")
    head = F.concat(
        O.octets((length / 4).cast("int") + 0x40, 1), O.part(data, F.col("at") + 1, 1), O.octets(length + F.length(body), 2), O.part(data, F.col("at") + 4, 2), O.octets(flags, 2),
        O.part(data, F.col("at") + 8, 2), F.lit(b"\0\0"), O.part(data, F.col("at") + 12, 8), F.col("own"),
    )
    d = d.withColumn("head", F.when(F.col("pieces") > 1, head)).withColumn("body_part", body)
    summed = F.concat(O.part(F.col("head"), 0, 10), O.octets(O.internet_checksum(F.col("head")), 2), O.part(F.col("head"), 12, 48))
    return d.select("num", "piece", F.when(F.col("pieces") > 1, F.concat(O.part(data, 0, F.col("at")), summed, F.col("body_part"))).otherwise(data).alias("data"))


def first_writer(pieces: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Disjoint (offset, octets) in order; of octets that several pieces hold, the first piece's stay.

    The held ranges are sorted lists; a piece looks only at those that it touches.
    """
    starts: list[int] = []
    held: list[bytes] = []
    for at, octets in pieces:
        end, new = at + len(octets), []
        k = max(0, bisect_right(starts, at) - 1)
        low = at
        while low < end:
            while k < len(starts) and starts[k] + len(held[k]) <= low:
                k += 1
            if k < len(starts) and starts[k] <= low:
                low = starts[k] + len(held[k])
                continue
            high = min(end, starts[k]) if k < len(starts) else end
            new.append((low, octets[low - at : high - at]))
            low = high
        for a, b in new:
            i = bisect_right(starts, a)
            starts.insert(i, a)
            held.insert(i, b)
    return list(zip(starts, held, strict=True))


class _Group:
    """The datagram that fragments under one key are adding up to; of octets that several hold, the first one's stay."""

    def __init__(self, of: tuple = (), began: float | None = None) -> None:
        self.of, self.began = of, began
        self.rows: list[tuple[int, bytes]] = []
        self.head, self.at, self.size, self.six = b"", -1, -1, False
        self.octets, self.held = bytearray(), []

    def add(self, num: int, data: bytes, at: int, body: int, end: int, offset: int, more: int) -> None:
        self.rows.append((num, data))
        if offset == 0 and self.at < 0:
            self.six = at < 0
            self.head, self.at = data[:body], -1 - at if self.six else at
        piece, stop, low = data[body:end], offset + end - body, offset
        if more == 0 and self.size < 0:
            self.size = stop
        self.octets.extend(bytes(max(0, stop - len(self.octets))))
        apart, first, last = [], offset, stop
        for a, b in self.held:
            if b < offset or a > stop:
                apart.append((a, b))
                continue
            if a > low:
                self.octets[low:a] = piece[low - offset : a - offset]
            low, first, last = max(low, b), min(first, a), max(last, b)
        if low < stop:
            self.octets[low:stop] = piece[low - offset :]
        self.held = sorted([*apart, (first, last)])

    def whole(self) -> bytes | None:
        """The frame, its header renewed, once every octet is there."""
        size = len(self.head) - self.at + self.size
        if self.at < 0 or self.held != [(0, self.size)] or size > OCTETS:
            return None
        h = bytearray(self.head)
        if self.six:  # the fragment header goes, the next header is what it named
            h[self.at + 4 : self.at + 6], h[self.at + 6] = self.size.to_bytes(2, "big"), h[self.at + 40]
            return bytes(h[: self.at + 40]) + bytes(self.octets)
        h[self.at + 2 : self.at + 4] = size.to_bytes(2, "big")
        h[self.at + 6 : self.at + 8] = bytes((h[self.at + 6] & 0xC0, 0))
        h[self.at + 10 : self.at + 12] = b"\0\0"
        total = sum(int.from_bytes(h[i : i + 2], "big") for i in range(self.at, len(h), 2))
        while total >> 16:
            total = (total & 0xFFFF) + (total >> 16)
        h[self.at + 10 : self.at + 12] = (0xFFFF - total).to_bytes(2, "big")
        return bytes(h) + bytes(self.octets)


def _datagrams(batches: Iterator[pd.DataFrame], own: list[str], age: float | None) -> Iterator[pd.DataFrame]:
    """From the fragments by key and num: a datagram as soon as it is whole, the others' fragments as they are."""
    key, group = None, _Group()
    left = lambda g: [(*g.of, num, data, 1, "incomplete") for num, data in g.rows]
    names = [*own, "num", "data", "fragments", "kind"]
    for b in batches:
        rows = []
        captures = list(zip(*(b[c] for c in own), strict=True)) if own else [()] * len(b)
        of = zip(b["ends"], b["id"], b["proto"], captures, strict=True)
        each = zip(b["time"], b["num"], b["data"], b["at"], b["body"], b["end"], b["offset"], b["more"], strict=True)
        for k, (time, num, data, at, body, end, offset, more) in zip(of, each, strict=True):
            if k != key:
                rows += left(group)
                key, group = k, _Group(k[-1])
            if group.rows and age is not None and time - group.began > age:  # the rest of it never came
                rows += left(group)
                group = _Group(k[-1])
            group.began = group.began if group.rows else time
            if offset + end - body > OCTETS or len(group.rows) >= FRAGMENTS:
                rows.append((*k[-1], num, data, 1, "incomplete"))
                continue
            group.add(num, data, at, body, end, offset, more)
            if (whole := group.whole()) is not None:
                rows.append((*k[-1], group.rows[0][0], whole, len(group.rows), "complete"))
                group = _Group(k[-1])
        yield pd.DataFrame(rows, columns=names)
    yield pd.DataFrame(left(group), columns=names)


#: Columns of a fragment, after those that tell captures apart.
FRAGMENT = "ends string, id bigint, proto bigint, time double, num bigint, data binary, at bigint, body bigint, end bigint, offset bigint, more bigint"


def fragments_apart(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames that are no fragments, as `defragment` gives them out, and the fragments: FRAGMENT, with other columns of the capture that tell it apart or are of its time."""
    d, own = decoded(df, (), ["off_IP", "off_IPv6"])[0], of_capture(df)
    extra = ["ts"] if "ts" in df.columns else []
    at, at6, data = F.col("off_IP"), F.col("off_IPv6"), F.col("data")
    flags = O.be(data, at + 6, 2)
    body = at + O.bits(data, at, 4, 4) * 4
    end = F.least(F.length(data), at + F.greatest(O.be(data, at + 2, 2), body - at)).cast("int")  # of the datagram, whatever is in it
    end6 = F.least(F.length(data), at6 + 40 + O.be(data, at6 + 4, 2)).cast("int")
    piece = F.coalesce((flags.bitwiseAND(0x3FFF) != 0) & (body <= end), F.lit(False))
    six = F.coalesce((O.be(data, at6 + 6, 1) == 44) & (end6 - at6 >= 48), F.lit(False))
    alone = d.where(~piece & ~six).select(*own, *extra, "num", "data", F.lit(1).cast("bigint").alias("fragments"), F.lit("whole").alias("kind"))
    word = O.be(data, at6 + 42, 2)
    by = lambda four, other: F.when(piece, four).otherwise(other)
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in own], by(F.hex(O.part(data, at + 12, 8)), F.hex(O.part(data, at6 + 8, 32))))
    # of IPv6 the protocol, which the first fragment tells, is no part of the key; and at is negative, less one
    pieces = d.where(piece | six).select(
        *own, *extra, key.alias("ends"), by(O.be(data, at + 4, 2), O.be(data, at6 + 44, 4)).alias("id"), by(O.be(data, at + 9, 1), F.lit(-1).cast("bigint")).alias("proto"),
        "time", "num", "data", by(at, -1 - at6).alias("at"), by(body, (at6 + 48).cast("bigint")).alias("body"), by(end, end6).alias("end"),
        by(flags.bitwiseAND(0x1FFF) * 8, word.bitwiseAND(0xFFF8)).alias("offset"), by(F.shiftright(flags, 13).bitwiseAND(1), word.bitwiseAND(1)).alias("more"),
    )
    kinds = [c.split(" ") for c in FRAGMENT.split(", ")]
    return alone, pieces.select(*own, *extra, *[F.col(c).cast(t).alias(c) for c, t in kinds])


def defragment(df: DataFrame, age: float | None = 60.0) -> DataFrame:
    """num (of the first fragment), data, fragments, kind of every frame.

    complete is a datagram put together from IPv4 fragments, or IPv6 ones (a fragment header right after the fixed one); incomplete is a fragment that no datagram was made of, as it
    was; whole is any other frame, as it was. Under a key (addresses, id, protocol), which comes back in a long
    capture, fragments are taken by num, and after each datagram the next one begins; so it does where a fragment comes more than `age`
    seconds (by `time`; None: however late) after the first one of what is not whole yet, which then is incomplete. A task walks the
    sorted fragments and holds those of one unfinished datagram, `FRAGMENTS` at most; what is over is incomplete.
    """
    own = of_capture(df)
    alone, pieces = fragments_apart(df.drop("ts"))
    keys = ["ends", "id", "proto"]
    kind = ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in own), "num bigint, data binary, fragments bigint, kind string"])
    dealt = pieces.repartition(*keys).sortWithinPartitions(*keys, "num", "offset")
    return alone.unionByName(dealt.mapInPandas(lambda it: _datagrams(it, own, age), kind))


def tcp_segments(df: DataFrame, block: int = NUMBERS) -> DataFrame:
    """stream, direction, num, rel (octet offset in the direction), flags, body of each TCP segment over IPv4 or IPv6.

    stream is direction-free. Direction 0 is who sent SYN without ACK, or else who sent first. Offsets count
    from the SYN's number plus one, or else from the first segment, and are of 64 bits: a number lies where its distance from
    the one before it in its direction says. With a column `capture`, the stream's name begins with it. Segments travel
    once, by stream, sender and block of numbers; what is known of a whole stream comes to them by a row for each block.
    """
    d, ready = decoded(df, ("IP.src", "IP.dst", "TCP.sport", "TCP.dport", "TCP.seq", "TCP.flags"), ["off_TCP", "off_IPv6", "_after", "_stop"])
    v = lambda spec: layer_column(spec, decoded=ready)
    d = d.where(F.col("off_TCP").isNotNull())
    six = lambda of: F.concat(F.lit("["), v(f"IPv6.{of}"), F.lit("]"))
    a = F.concat_ws(":", F.coalesce(v("IP.src"), six("src")), v("TCP.sport").cast("string"))
    b = F.concat_ws(":", F.coalesce(v("IP.dst"), six("dst")), v("TCP.dport").cast("string"))
    number = LAYERS["TCP"].raw("flags", ready).bitwiseAND(255)
    own = [F.col(c).cast("string") for c in of_capture(df)]
    stream = F.concat_ws(" - ", *own, F.least(a, b), F.greatest(a, b)).alias("stream")
    s = d.select(stream, a.alias("sender"), "num", v("TCP.seq").alias("seq"), number.alias("flags"), payload().alias("body"))
    key, syn, ack = ["stream", "sender"], F.col("flags").bitwiseAND(2) != 0, F.col("flags").bitwiseAND(16) != 0
    line = sequence_line(s, key, "seq", block)
    one = F.when(syn, 1).otherwise(0)  # a SYN takes a number of its own
    opening = F.min(F.struct(F.when(syn & ~ack, 0).otherwise(1).alias("k"), "num")).alias("opening")
    begin = F.min(F.struct(F.when(syn, 0).otherwise(1).alias("k"), "num", (F.col("_in") + one).alias("at"))).alias("begin")
    blocks = carried(line, key, "seq", opening, begin)
    best = F.min(F.struct("begin.k", "begin.num", (F.col("begin.at") + F.col("_carry")).alias("at"))).over(Window.partitionBy(*key))
    opener = F.min(F.struct("opening", "sender")).over(Window.partitionBy("stream"))
    direction = F.when(opener["sender"] == F.col("sender"), 0).otherwise(1).alias("direction")
    blocks = blocks.select(*key, "_block", (F.col("_carry") - best["at"]).alias("_shift"), direction)
    rel = (F.col("_in") + F.col("_shift") + one).alias("rel")
    return line.join(blocks, [*key, "_block"]).select("stream", "direction", "num", rel, "flags", "body")


def _block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("num")
    held = first_writer(list(zip(pdf["at"].tolist(), pdf["piece"].tolist(), strict=True)))
    stream, direction, block = key
    return pd.DataFrame({"stream": stream, "direction": direction, "block": block, "at": [a for a, _ in held], "octets": [b for _, b in held]})


def stream_pieces(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """stream, direction, block, at, octets: what was received, each octet once; gaps are what is missing between."""
    s = tcp_segments(df).where((F.length("body") > 0) & (F.col("rel") + F.length("body") > 0))
    first, last = F.floor(F.greatest(F.col("rel"), F.lit(0)) / block), F.floor((F.col("rel") + F.length("body") - 1) / block)
    s = s.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("rel"), F.col("block") * block)  # what is from before the start is cut off
    high = F.least(F.col("rel") + F.length("body"), (F.col("block") + 1) * block)
    s = s.select("stream", "direction", "block", "num", low.alias("at"), O.part(F.col("body"), low - F.col("rel"), high - low).alias("piece"))
    # exact retransmissions are dropped before the shuffle's groups are made
    s = s.groupBy("stream", "direction", "block", "at", "piece").agg(F.min("num").alias("num"))
    return s.groupBy("stream", "direction", "block").applyInPandas(_block, "stream string, direction int, block bigint, at bigint, octets binary")


def streams(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """stream, direction, segments, octets, missing (gap octets), dropped, syn, fin, rst of each direction that sent anything.

    dropped are octets of segments, or of their parts, from before the direction's start; octets that came twice count once. Only
    where segments begin and end travels, in blocks of `block` octets.
    """
    s = tcp_segments(df).select("stream", "direction", "num", "rel", "flags", (F.col("rel") + F.length("body")).alias("stop"))
    early = F.least(F.col("stop"), F.lit(0)) - F.least(F.col("rel"), F.lit(0))
    at, stop = F.greatest(F.col("rel"), F.lit(0)), F.greatest(F.col("stop"), F.lit(0))
    s = s.select("stream", "direction", "flags", early.alias("early"), at.alias("at"), stop.alias("stop"))
    s = s.groupBy("stream", "direction", "at", "stop").agg(F.bit_or("flags").alias("flags"), F.count("*").alias("n"), F.sum("early").alias("early"))
    first, last = F.floor(F.col("at") / block), F.floor((F.greatest(F.col("stop") - 1, F.col("at"))) / block)
    s = s.withColumn("block", F.explode(F.sequence(first, last)))
    begins, low, high = first == F.col("block"), F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("stop"), (F.col("block") + 1) * block)
    counted = [F.when(begins, F.col(c)).otherwise(0).alias(c) for c in ("n", "early")]
    s = s.select("stream", "direction", "block", "flags", *counted, low.alias("low"), high.alias("high"))
    before = Window.partitionBy("stream", "direction", "block").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("high") - F.greatest(F.col("low"), F.coalesce(F.max("high").over(before), F.col("low"))))
    totals = s.withColumn("new", new).groupBy("stream", "direction").agg(
        F.bit_or("flags").alias("flags"),
        F.sum("n").alias("segments"),
        F.sum("new").alias("octets"),
        F.max(F.when(F.col("high") > F.col("low"), F.col("high"))).alias("reach"),
        F.sum("early").alias("dropped"),
    )
    bit = lambda k: F.col("flags").bitwiseAND(k) != 0
    missing = F.coalesce("reach", F.lit(0)) - F.col("octets")
    return totals.select("stream", "direction", "segments", "octets", missing.alias("missing"), "dropped", bit(2).alias("syn"), bit(1).alias("fin"), bit(4).alias("rst"))


class _Framer:
    """Complete HTTP/1 messages of octets that arrive in order; what isn't framed yet is carried on."""

    def __init__(self) -> None:
        self.data, self.at, self.seen, self.open = bytearray(), 0, 0, True
        #: Of the message whose head is there: start line, begin of the body, its end or None if chunked, next chunk line, chunks.
        self.head: tuple | None = None

    def feed(self, octets: bytes) -> Iterator[tuple[int, int, str, bytes]]:
        """(offset, length, start line, body) of what is complete now."""
        self.data += octets
        while self.open and (self.head or self._head()) and (found := self._body()):
            end, content = found
            yield self.at, end, self.head[0], content
            del self.data[:end]
            self.at, self.seen, self.head = self.at + end, 0, None

    def _head(self) -> bool:
        found = HEAD_END.search(self.data, max(0, self.seen - 3), HEAD)
        if not found:
            self.seen, self.open = len(self.data), len(self.data) < HEAD
            return False
        # a line that begins with a blank goes on with the one before it
        lines = re.split(rb"\r?\n", re.sub(rb"\r?\n[ \t]+", b" ", bytes(self.data[: found.start()])))
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        body, end = found.end(), None
        if re.match(rb"HTTP/\d\.\d (1\d\d|204|304)\b", lines[0]):
            end = body  # these never have a body, whatever their headers say
        elif b"chunked" in headers.get(b"transfer-encoding", b"").lower():
            pass
        elif b"content-length" in headers:
            digits = re.match(rb"\d{1,19}", headers[b"content-length"])
            self.open = digits is not None
            end = body + int(digits[0]) if digits else 0
        elif lines[0].startswith(b"HTTP/"):
            self.open = False  # ends with the stream, which can't be told from a lost end
        else:
            end = body
        self.head = (lines[0].decode("latin-1"), body, end, [body], [])
        return self.open

    def _body(self) -> tuple[int, bytes] | None:
        _, body, end, upto, parts = self.head
        if end is not None:
            return (end, bytes(self.data[body:end])) if len(self.data) >= end else None
        while (line := self.data.find(b"\r\n", upto[0])) >= 0:
            size = re.match(rb"\s*([0-9A-Fa-f]+)\s*(;|$)", bytes(self.data[upto[0] : line]))
            if size is None:
                self.open = False
                return None
            n = int(size[1], 16)
            if n == 0:  # trailers up to an empty line
                stop = line if self.data[line + 2 : line + 4] == b"\r\n" else self.data.find(b"\r\n\r\n", line + 2)
                return (stop + 4, b"".join(parts)) if stop >= 0 else None
            if len(self.data) < line + 4 + n:
                return None
            parts.append(bytes(self.data[line + 2 : line + 2 + n]))
            upto[0] = line + 4 + n
        return None


def _framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages from the pieces by stream, direction and offset; what follows a direction's first gap isn't framed."""
    key, upto, framer = None, 0, _Framer()
    for b in batches:
        rows = []
        for stream, direction, at, octets in zip(b["stream"], b["direction"], b["at"], b["octets"], strict=True):
            if (stream, direction) != key:
                key, upto, framer = (stream, direction), 0, _Framer()
            if at == upto and framer.open:
                rows += [(stream, direction, *m) for m in framer.feed(octets)]
                upto += len(octets)
        yield pd.DataFrame(rows, columns=["stream", "direction", "at", "length", "start_line", "body"])


def http_messages(df: DataFrame) -> DataFrame:
    """stream, direction, at, length, start_line, body of each complete message before the first gap of its direction.

    A task walks the sorted pieces of a direction and holds what isn't framed yet, so one message. Framing ends at a head of
    over `HEAD` octets, at a length that is none, and at a response without a length, as nothing tells where the next begins (1xx, 204 and
    304 never have a body). Heads may have bare line feeds and folded lines.
    """
    p = stream_pieces(df).repartition("stream", "direction").sortWithinPartitions("stream", "direction", "at")
    return p.select("stream", "direction", "at", "octets").mapInPandas(_framed, "stream string, direction int, at bigint, length bigint, start_line string, body binary")


def _tls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """TLS records from the pieces by stream, direction and offset, before a direction's first gap or what is no record."""
    key, upto, start, held, good = None, 0, 0, bytearray(), True
    for b in batches:
        rows = []
        for stream, direction, at, octets in zip(b["stream"], b["direction"], b["at"], b["octets"], strict=True):
            if (stream, direction) != key:
                key, upto, start, held, good = (stream, direction), 0, 0, bytearray(), True
            if at != upto or not good:
                continue
            held += octets
            upto += len(octets)
            done = 0
            while good and len(held) - done >= 5:
                kind, major, size = held[done], held[done + 1], int.from_bytes(held[done + 3 : done + 5], "big")
                good = kind in (20, 21, 22, 23) and major == 3 and size <= RECORD
                if not good or len(held) - done < 5 + size:
                    break
                rows.append((stream, direction, start + done, kind, int.from_bytes(held[done + 1 : done + 3], "big"), size, bytes(held[done + 5 : done + 5 + size])))
                done += 5 + size
            del held[:done]
            start += done
        yield pd.DataFrame(rows, columns=["stream", "direction", "at", "type", "version", "length", "body"])


def tls_records(df: DataFrame) -> DataFrame:
    """stream, direction, at, type, version, length, body of each complete TLS record before the first gap of its direction; a task holds one record."""
    p = stream_pieces(df).repartition("stream", "direction").sortWithinPartitions("stream", "direction", "at")
    return p.select("stream", "direction", "at", "octets").mapInPandas(_tls, "stream string, direction int, at bigint, type int, version int, length int, body binary")


def _prefixed(batches: Iterator[pd.DataFrame], size: int, most: int) -> Iterator[pd.DataFrame]:
    """Messages that a length stands before, from the pieces by stream, direction and offset, before a direction's first gap."""
    key, upto, start, held, good = None, 0, 0, bytearray(), True
    for b in batches:
        rows = []
        for stream, direction, at, octets in zip(b["stream"], b["direction"], b["at"], b["octets"], strict=True):
            if (stream, direction) != key:
                key, upto, start, held, good = (stream, direction), 0, 0, bytearray(), True
            if at != upto or not good:
                continue
            held += octets
            upto += len(octets)
            done = 0
            while good and len(held) - done >= size:
                n = int.from_bytes(held[done : done + size], "big")
                good = n <= most
                if not good or len(held) - done < size + n:
                    break
                rows.append((stream, direction, start + done, size + n, bytes(held[done + size : done + size + n])))
                done += size + n
            del held[:done]
            start += done
        yield pd.DataFrame(rows, columns=["stream", "direction", "at", "length", "body"])


def prefixed_messages(df: DataFrame, size: int = 2, most: int = 1 << 24) -> DataFrame:
    """stream, direction, at, length, body of each message with its length (of `size` octets) before it, as DNS over TCP; a length of over `most` ends a direction."""
    p = stream_pieces(df).repartition("stream", "direction").sortWithinPartitions("stream", "direction", "at")
    kind = "stream string, direction int, at bigint, length bigint, body binary"
    return p.select("stream", "direction", "at", "octets").mapInPandas(lambda batches: _prefixed(batches, size, most), kind)


def spliced(df: DataFrame, messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """num, stream, direction, at, kind, octets: each complete message in place of the octets that carried it, everything else as it is.

    messages: stream, direction, at, length, body, as of http_messages or tls_records. Of a segment stays what no message covers: nothing, or
    a row for each part. The message takes the number of the last segment that it needs. Segments and messages meet by blocks of their direction.
    """
    own = ["stream", "direction"]
    s = tcp_segments(df).withColumn("reach", F.col("rel") + F.length("body"))
    blocks = lambda low, high: F.explode(F.sequence(F.floor(low / block), F.floor((high - 1) / block)))
    held = s.where("reach > rel").select(*own, "num", "rel", "reach").withColumn("block", blocks(F.col("rel"), F.col("reach")))
    m = messages.where("length > 0").select(*own, "at", (F.col("at") + F.col("length")).alias("stop"))
    m = m.withColumn("block", blocks(F.col("at"), F.col("stop")))
    low, high = F.greatest("rel", "at"), F.least("reach", "stop")
    met = held.join(m, [*own, "block"]).where((low < high) & (F.floor(low / block) == F.col("block")))  # each pair once
    last = met.groupBy(*own, "at").agg(F.max("num").alias("num"))
    whole = messages.select(*own, "at", F.col("body").alias("octets")).join(last, [*own, "at"])
    covered = met.groupBy(*own, "num", "rel", "reach").agg(F.sort_array(F.collect_list(F.struct(low.alias("low"), high.alias("high")))).alias("covered"))
    n = F.size("covered")
    edges = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.struct(
            F.when(k == 0, F.col("rel")).otherwise(F.try_element_at("covered", F.greatest(k, F.lit(1)))["high"]).alias("low"),
            F.when(k == n, F.col("reach")).otherwise(F.try_element_at("covered", k + 1)["low"]).alias("high"),
        ),
    )
    left = covered.select(*own, "num", "rel", "reach", F.filter(edges, lambda e: e["high"] > e["low"]).alias("left"))
    s = s.join(left, [*own, "num", "rel", "reach"], "left")
    parts = F.coalesce("left", F.array(F.struct(F.col("rel").alias("low"), F.col("reach").alias("high"))))
    rest = s.withColumn("part", F.explode(parts))
    rest = rest.select("num", *own, F.col("part.low").alias("at"), F.lit("segment").alias("kind"), O.part(F.col("body"), F.col("part.low") - F.col("rel"), F.col("part.high") - F.col("part.low")).alias("octets"))
    return whole.select("num", *own, "at", F.lit("message").alias("kind"), "octets").unionByName(rest)
