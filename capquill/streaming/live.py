"""The analytic path over streams of packets, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from capquill.operators import reassembly as R
from capquill.operators.dissect import dissect, keep
from capquill.operators.flows import of_capture, session_key
from capquill.operators.reassembly import first_writer


def sniff(stream: DataFrame, where: Sequence[tuple] = (), layer: str | None = None, prn: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None):
    """Start a query over a stream of captures; prn gets each batch of kept packets. Stops when all that is there is read."""
    writer = keep(stream, where, layer).writeStream.trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(prn or (lambda df, _: None)).start()


def flow_windows(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """session, start, packets, octets by tumbling windows of event time; packets that are too late are dropped."""
    d = dissect(stream).withColumn("ts", F.timestamp_micros((F.col("time") * 1_000_000).cast("bigint"))).withWatermark("ts", late)
    counted = d.groupBy(F.window("ts", window).alias("w"), session_key().alias("session")).agg(F.count("*").alias("packets"), F.sum(F.length("data")).alias("octets"))
    return counted.select("session", F.col("w.start").alias("start"), "packets", "octets")


_OUT = "stream string, direction int, at bigint, octets binary, evicted boolean"
_STATE = "next bigint, at array<bigint>, held array<binary>"


def follow(segments: DataFrame, idle: str = "30 minutes", most: int = 1 << 20) -> DataFrame:
    """Octets of each direction in order, as soon as nothing is missing before them.

    segments: stream, direction, num, rel, body (as of `tcp_segments`, offsets known when they arrive). State is what
    is held behind a gap; beyond `most` octets, or after the idle time, it is given out with evicted = true.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, at, held = state.get if state.exists else (0, [], [])
        late = state.hasTimedOut
        pieces = list(zip(at, map(bytes, held), strict=True))
        for b in [] if late else batches:
            pieces += [(int(a), bytes(o)) for a, o in zip(*(b.sort_values("num")[c] for c in ("rel", "body")), strict=True)]
        out, left = [], []
        for a, o in first_writer([p for p in pieces if p[0] + len(p[1]) > upto]):
            if a <= upto:
                out.append((*key, upto, o[upto - a :], False))
                upto = a + len(o)
            else:
                left.append((a, o))
        if late or sum(len(o) for _, o in left) > most:
            out += [(*key, a, o, True) for a, o in left]
            upto, left = max([upto, *(a + len(o) for a, o in left)]), []
        if late:
            state.remove()
        else:
            state.update((upto, [a for a, _ in left], [o for _, o in left]))
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["stream", "direction", "at", "octets", "evicted"])

    return segments.groupBy("stream", "direction").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


_HELD = [c.split(" ")[0] for c in R.FRAGMENT.split(", ")]


class Defragmenter(StatefulProcessor):
    """Fragments under one key: a list state of those of one unfinished datagram, and a timer for when it is given up."""

    def __init__(self, own: list[str], age: float, most: int):
        self.own, self.age, self.most = own, age, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", R.FRAGMENT)

    def _out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key[: len(self.own)], *r) for r in rows], columns=[*self.own, "num", "data", "fragments", "kind"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self.held.get()]
        new = [tuple(r) for b in rows for r in b[_HELD].itertuples(index=False)]
        out, left = [], []
        group, octets = R._Group(), 0
        for r in [*before, *sorted(new, key=lambda r: (r[4], r[9]))]:
            time, num, data, at, body, end, offset, more = r[3:]
            if left and (time - group.began > self.age or octets + len(data) > self.most):
                out += [(n, d, 1, "incomplete") for n, d in group.rows]
                group, left, octets = R._Group(), [], 0
            if offset + end - body > R.OCTETS or len(data) > self.most:
                out.append((num, data, 1, "incomplete"))
                continue
            group.began = group.began if left else time
            group.add(num, bytes(data), at, body, end, offset, more)
            left.append(r)
            octets += len(data)
            if (whole := group.whole()) is not None:
                out.append((min(n for n, _ in group.rows), whole, len(group.rows), "complete"))
                group, left, octets = R._Group(), [], 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.held.put(left)
            self.handle.registerTimer(int((group.began + self.age) * 1000))
        else:
            self.held.clear()
        yield self._out(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(r[4], bytes(r[5]), 1, "incomplete") for r in self.held.get()]
        self.held.clear()
        yield self._out(key, out)

    def close(self) -> None:
        pass


def defragmented(packets: DataFrame, age: float = 60.0, late: str = "10 seconds", most: int = 1 << 20) -> DataFrame:
    """`reassembly.defragment` over a stream of captures: num, data, fragments, kind of every frame.

    A datagram comes out once it is whole, whichever batches its fragments came with. What isn't whole `age` seconds (of the
    packets' own time) after its first fragment is given out as incomplete, and so is what would hold more than `most` octets under
    one key. Needs the RocksDB state store.
    """
    own = of_capture(packets)
    timed = packets.withColumn("ts", F.timestamp_micros((F.col("time") * 1_000_000).cast("bigint"))).withWatermark("ts", late)
    alone, pieces = R.fragments_apart(timed)
    kinds = dict(packets.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in own), "num bigint, data binary, fragments bigint, kind string"])
    held = pieces.groupBy(*own, "ends", "id", "proto").transformWithStateInPandas(Defragmenter(own, age, most), schema, "Append", "EventTime")
    return alone.drop("ts").unionByName(held)
