"""Aggregations over dissected captures: flows, protocol counts, conversations, pivots, lagged series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capquill.operators.dissect import dissect, is_dissected, layer_column
from capquill.operators.layers import LAYERS


def _text(spec: str, decoded: bool = False) -> Column:
    return layer_column(spec, decoded=decoded).cast("string")


def decoded(df: DataFrame, fields: Sequence[str], slim: Sequence[str] | None = None) -> tuple[DataFrame, bool]:
    """The dissected capture, and whether it has these fields decoded: it has, unless it was dissected before. slim: as of `dissect`."""
    return (df, False) if is_dissected(df) else (dissect(df, fields=fields, slim=slim), True)


#: Fields that session_key reads.
KEY_FIELDS = ("IP.src", "IP.dst", "IP.proto", "IPv6.nh", "TCP.sport", "TCP.dport", "UDP.sport", "UDP.dport", "ICMP.type", "ICMP.code", "ICMP.id", "ARP.psrc", "ARP.pdst", "Ether.type")
#: Columns that session_key reads besides.
KEY_ANCHORS = [f"off_{n}" for n in ("TCP", "UDP", "IPv6", "ICMP", "IP", "ARP", "Ether")]


def session_key(decoded: bool = False) -> Column:
    """Directional flow key of a packet; decoded: of a capture with KEY_FIELDS decoded."""
    _text = lambda spec: layer_column(spec, decoded=decoded).cast("string")
    has = lambda n: F.col(f"off_{n}").isNotNull()
    hex4 = lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")
    src, dst = F.coalesce(_text("IP.src"), _text("IPv6.src")), F.coalesce(_text("IP.dst"), _text("IPv6.dst"))
    both = F.concat(src, F.lit(" > "), dst)
    ports = lambda n: F.concat(F.lit(n + " "), src, F.lit(":"), _text(f"{n}.sport"), F.lit(" > "), dst, F.lit(":"), _text(f"{n}.dport"))
    echo = F.concat(F.lit("ICMP "), both, F.lit(" type="), _text("ICMP.type"), F.lit(" code="), _text("ICMP.code"), F.coalesce(F.concat(F.lit(" id=0x"), F.lower(F.hex(layer_column("ICMP.id", decoded=decoded)))), F.lit("")))
    return (
        F.when(has("TCP"), ports("TCP")).when(has("UDP"), ports("UDP"))
        .when(has("IPv6"), F.concat(F.lit("IPv6 "), both, F.lit(" nh="), _text("IPv6.nh")))
        .when(has("ICMP"), echo)
        .when(has("IP"), F.concat(F.lit("IP "), both, F.lit(" proto="), _text("IP.proto")))
        .when(has("ARP"), F.concat(F.lit("ARP "), _text("ARP.psrc"), F.lit(" > "), _text("ARP.pdst")))
        .when(has("Ether"), F.concat(F.lit("Ethernet type="), hex4(layer_column("Ether.type", decoded=decoded))))
        .otherwise("Other")
    )


def of_capture(df: DataFrame) -> list[str]:
    """["capture"] if packets of several captures are told apart by such a column, else []."""
    return ["capture"] if "capture" in df.columns else []


def sessions(df: DataFrame, key: Column | None = None) -> DataFrame:
    """session, packets, octets, first_num, last_num of each flow, of each capture for itself; pre-aggregated, packets are never gathered."""
    own = of_capture(df)
    d, ready = decoded(df, KEY_FIELDS, KEY_ANCHORS) if key is None else decoded(df, ())
    keyed = d.select(*own, (session_key(ready) if key is None else key).alias("session"), "num", F.length("data").alias("size"))
    return keyed.groupBy(*own, "session").agg(F.count("*").alias("packets"), F.sum("size").cast("bigint").alias("octets"), F.min("num").alias("first_num"), F.max("num").alias("last_num"))


def session_windows(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Flows that end after a gap without packets, of each capture for itself."""
    own = of_capture(df)
    d, ready = decoded(df, KEY_FIELDS, KEY_ANCHORS)
    keyed = d.select(*own, session_key(ready).alias("session"), F.timestamp_micros(F.floor(F.col("time") * 1_000_000 + 0.5)).alias("ts"))
    met = keyed.groupBy(*own, "session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("packets"))
    return met.select(*own, "session", F.unix_micros("w.start").alias("start_us"), "packets")


def count_layers(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """layer, packets."""
    counts = decoded(df, (), [f"off_{n}" for n in layers])[0].agg(*[F.count(f"off_{n}").alias(n) for n in layers])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, layers)), F.array(*[F.col(n) for n in layers]))).alias("layer", "packets"))


def protocol_stats(df: DataFrame, layers: Sequence[str] = ("TCP", "UDP", "ICMP")) -> DataFrame:
    """bucket, packets: each packet counts once, at the first of the names that it has; else as Other."""
    bucket = F.coalesce(*[F.when(F.array_contains("chain", n), F.lit(n)) for n in layers], F.lit("Other"))
    return decoded(df, (), ["chain"])[0].groupBy(bucket.alias("bucket")).agg(F.count("*").alias("packets"))


def conversations(df: DataFrame) -> DataFrame:
    """src, dst, packets by IP, else IPv6, else ARP addresses; other packets have no conversation."""
    d, ready = decoded(df, ("IP.src", "IP.dst", "ARP.psrc", "ARP.pdst"), ["off_IPv6"])
    src, dst = (F.coalesce(*[_text(s, ready) for s in specs]) for specs in (("IP.src", "IPv6.src", "ARP.psrc"), ("IP.dst", "IPv6.dst", "ARP.pdst")))
    return d.select(src.alias("src"), dst.alias("dst")).where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("packets"))


def afterglow(df: DataFrame, event: str = "TCP.dport") -> DataFrame:
    """src, event, dst, packets: distinct edges of source, event and destination."""
    e = dissect(df).select(_text("IP.src").alias("src"), _text(event).alias("event"), _text("IP.dst").alias("dst"))
    return e.where("src is not null and event is not null").groupBy("src", "event", "dst").agg(F.count("*").alias("packets"))


def table(df: DataFrame, column: Column, row: Column, cell: Column) -> DataFrame:
    """col, row, cell in long form; of several packets for a cell the last one counts (of equal numbers the greatest cell)."""
    keyed = dissect(df).select(column.alias("col"), row.alias("row"), cell.alias("cell"), "num").where("col is not null and row is not null")
    return keyed.groupBy("col", "row").agg(F.max_by("cell", F.struct("num", "cell")).alias("cell"))


def pivot(df: DataFrame, column: Column, row: Column, cell: Column, values: Sequence[str]) -> DataFrame:
    """One column per value, `-` where a cell is missing."""
    long = table(df, column, row, cell)
    return long.groupBy("row").pivot("col", list(values)).agg(F.first(F.col("cell").cast("string"))).na.fill("-")


#: Numbers of packets in one block of a sequence line.
NUMBERS = 1 << 20


def lagged(df: DataFrame, value: Column, delay: int = 1, by: str = "capture", block: int = NUMBERS) -> DataFrame:
    """num, diff: value of the packet `delay` later in the same capture, less its own; null values give no row.

    No task holds a whole capture: packets are counted off in blocks of their numbers, which a row for each block carries
    on, and then each packet is sent to its own place and, as the later one, to the place `delay` before it.
    """
    d = df.select(F.col(by).alias("_by"), "num", value.alias("v"), F.floor(F.col("num") / block).alias("_block"))
    order = Window.partitionBy("_of").orderBy("_of_block")
    sizes = d.groupBy(F.col("_by").alias("_of"), F.col("_block").alias("_of_block")).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_of", "_of_block", (F.sum("_n").over(order) - F.col("_n")).alias("_carry"))
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_by", "_block").orderBy("num")))
    d = d.join(sizes, F.col("_by").eqNullSafe(F.col("_of")) & F.col("_block").eqNullSafe(F.col("_of_block")))
    at = F.col("_carry") + F.col("_nth")
    own = F.struct(at.alias("at"), F.col("num"), F.col("v"), F.lit(None).alias("later"))
    later = F.struct((at - delay).alias("at"), F.lit(None).alias("num"), F.lit(None).alias("v"), F.col("v").alias("later"))
    placed = d.select("_by", F.explode(F.array(own, later)).alias("p")).select("_by", "p.*")
    met = placed.groupBy("_by", "at").agg(F.max("num").alias("num"), (F.max("later") - F.max("v")).alias("diff"))
    return met.select("num", "diff").where("diff is not null")


def serial(later: Column, sooner: Column) -> Column:
    """The difference of two 32-bit sequence numbers as the nearer one of the two that it may be."""
    return F.pmod(later - sooner + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def sequence_line(df: DataFrame, key: Sequence[str], seq: str = "seq", block: int = NUMBERS) -> DataFrame:
    """df with _block and _in: 32-bit numbers unwrapped within blocks of packets, from 0 at a block's first one.

    A number lies as far from the one before it (by num) as their serial difference says, so neighbours may differ by less than
    2**31, but a line may be of any length. `carried` puts the blocks one behind the other.
    """
    order = Window.partitionBy(*key, "_block").orderBy("num")
    cut = df.withColumn("_block", F.floor(F.col("num") / block))
    step = F.coalesce(serial(F.col(seq), F.lag(seq).over(order)), F.lit(0))
    return cut.withColumn("_step", step).withColumn("_in", F.sum("_step").over(order)).drop("_step")


def carried(line: DataFrame, key: Sequence[str], seq: str = "seq", *more: Column) -> DataFrame:
    """key, _block, _carry (what is added to a block's _in) and more aggregates of each block of a sequence line."""
    ends = (F.min_by(seq, "num").alias("_first"), F.max_by(seq, "num").alias("_last"), F.max_by("_in", "num").alias("_run"))
    blocks = line.groupBy(*key, "_block").agg(*ends, *more)
    order = Window.partitionBy(*key).orderBy("_block")
    jump = F.lag("_run").over(order) + serial(F.col("_first"), F.lag("_last").over(order))
    blocks = blocks.withColumn("_jump", F.coalesce(jump, F.lit(0))).withColumn("_carry", F.sum("_jump").over(order))
    return blocks.drop("_first", "_last", "_run", "_jump")


def relative_sequence(df: DataFrame, key: Sequence[str], seq: str = "seq", block: int = NUMBERS) -> DataFrame:
    """df with rel: 32-bit sequence numbers of each key as distances from its first one, of 64 bits.

    No task holds a whole key: rows are summed up in blocks of their numbers, and a row for each block carries the sums on.
    """
    line = sequence_line(df, key, seq, block)
    out = line.join(carried(line, key, seq), [*key, "_block"])
    return out.withColumn("rel", F.col("_in") + F.col("_carry")).select(*df.columns, "rel")


def ack_consistent(df: DataFrame) -> DataFrame:
    """num, expected, consistent of TCP packets that acknowledge the one before in their stream's other direction.

    expected is seq + payload + SYN + FIN of the last packet of the other direction, modulo 2**32; consistent is null
    without the ACK flag or without such a packet. An advisory check of neighbours, not a reassembly.
    """
    own = of_capture(df)
    d = dissect(df).where(F.col("off_TCP").isNotNull())
    src, dst = (F.concat_ws(":", F.coalesce(_text(f"IP.{e}"), _text(f"IPv6.{e}")), _text(f"TCP.{p}")) for e, p in (("src", "sport"), ("dst", "dport")))
    flags = layer_column("TCP.seq"), layer_column("TCP.ack"), LAYERS["TCP"].raw("flags")
    sent = F.greatest(F.col("_stop") - F.col("_after"), F.lit(0)) + F.shiftright(flags[2], 1).bitwiseAND(1) + flags[2].bitwiseAND(1)
    s = d.select(*own, "num", F.concat_ws(" - ", F.least(src, dst), F.greatest(src, dst)).alias("stream"), (src < dst).alias("up"), F.pmod(flags[0] + sent, F.lit(1 << 32)).alias("next"), flags[1].alias("ack"), (flags[2].bitwiseAND(16) != 0).alias("acks"))
    before = Window.partitionBy(*own, "stream").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda up: F.last(F.when(F.col("up") == up, F.col("next")), ignorenulls=True).over(before)
    s = s.withColumn("_a", last(True)).withColumn("_b", last(False)).withColumn("expected", F.when(F.col("up"), F.col("_b")).otherwise(F.col("_a")))
    return s.select(*own, "num", "expected", F.when(F.col("acks"), F.col("ack") == F.col("expected")).alias("consistent"))


def time_skew(df: DataFrame, stamp: Column) -> DataFrame:
    """src, num, x, skew of a sender's clock against the capture's: stamp is its time in milliseconds, its first packet the origin.

    A stamp has 32 bits and begins anew after 49.7 days, so of the times that it may stand for the one nearest to the capture's counts.
    """
    own = of_capture(df)
    d = dissect(df).select(*own, F.coalesce(_text("IP.src"), _text("IPv6.src")).alias("src"), "num", "time", stamp.cast("double").alias("stamp")).where("src is not null and stamp is not null")
    first = d.groupBy(*own, "src").agg(F.min_by(F.struct("time", "stamp"), "num").alias("first"))
    d = d.join(first, [*own, "src"])
    elapsed, told = F.col("time") - F.col("first.time"), F.col("stamp") - F.col("first.stamp")
    turns = F.floor((elapsed * 1000 - told) / (1 << 32) + 0.5)
    skew = elapsed - (told + turns * F.lit(1 << 32)) / 1000
    return d.select(*own, "src", "num", (F.col("time") % 2000).alias("x"), skew.alias("skew"))


def series(df: DataFrame, label: Column, value: Column) -> DataFrame:
    """label, num, value in long form: a series of each label in the order of num, rows without a label or value left out."""
    return dissect(df).select(label.alias("label"), "num", value.alias("value")).where("label is not null and value is not null")


def top(df: DataFrame, key: Column, k: int) -> DataFrame:
    """The k most frequent values of key with their packets; of equal counts the lesser key comes first."""
    return dissect(df).select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "key").limit(k)


def take(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The packets of these numbers, in the order given, once for each time that a number is given; `at` is the place in it."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(positions)), "at bigint, num bigint")
    return df.join(F.broadcast(wanted), "num")


def dot(edges: DataFrame, source: str, target: str, label: str) -> DataFrame:
    """line: the lines of a DOT document of the edges, to be written with `write.text`."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = edges.select(F.lit(1).alias("k"), F.concat(F.lit("  "), quoted(source), F.lit(" -> "), quoted(target), F.lit(" [label="), quoted(label), F.lit("];")).alias("line"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph capture {"), (2, "}")], "k int, line string")
    return body.unionByName(ends).orderBy("k", "line").select("line")
