"""Requests and replies: equi-joins on a conversation key, never all pairs of a capture."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capquill.functions import octets as O
from capquill.operators.dissect import dissect, layer_column
from capquill.operators.flows import decoded, of_capture
from capquill.operators.layers import LAYERS


#: Fields that reply_key reads.
KEY_FIELDS = (
    "IP.src", "IP.dst", "TCP.sport", "TCP.dport", "UDP.sport", "UDP.dport", "ICMP.type", "ICMP.id", "ICMP.seq", "ICMPv6.type", "DNS.id", "DNS.qr",
    "ARP.op", "ARP.psrc", "ARP.pdst",
)
#: Columns that reply_key reads besides.
KEY_ANCHORS = [*(f"off_{n}" for n in ("TCP", "UDP", "DNS", "ICMP", "ICMPv6", "ARP", "IPv6")), "_stop"]
#: ICMP and ICMPv6 types of requests, with those of their replies.
ICMP_REPLIES, ICMP6_REPLIES, NEIGHBOUR = {8: 0, 13: 14, 15: 16, 17: 18}, {128: 129}, (135, 136)


def reply_key(reverse: bool, decoded: bool = False) -> Column:
    """Key under which a packet meets its answers (reverse: of an answer, with its ends swapped); null if it has no rule.

    TCP and UDP go by addresses and ports, DNS by its id as well (and a message that says it is a response never asks), echo and the
    other queries of ICMP by id and sequence number, ICMPv6 echo likewise, neighbour discovery by the target, ARP by its
    addresses. A key lacks no part: a packet without one of them has no key. decoded: of a capture with KEY_FIELDS decoded.
    """
    v = lambda s: layer_column(s, decoded=decoded)
    t = lambda s: v(s).cast("string")
    has = lambda n: F.col(f"off_{n}").isNotNull()
    joined = lambda kind, *parts: F.concat(F.lit(kind), *[x for p in parts for x in (F.lit("|"), p)])  # noqa: E731, null if a part is
    swap = (lambda a, b: (b, a)) if reverse else (lambda a, b: (a, b))
    end = lambda of: F.coalesce(LAYERS["IP"].raw(of, decoded).cast("string"), F.hex(LAYERS["IPv6"].raw(of)))
    ends = swap(end("src"), end("dst"))
    ports = lambda n: swap(t(f"{n}.sport"), t(f"{n}.dport"))

    def by_type(kind: Column, replies: dict[int, int]) -> Column:
        """The request's type, of a request or (reverse) of a reply."""
        asked = F.lit(None).cast("string")
        for ask, reply in replies.items():
            asked = F.when(kind == (reply if reverse else ask), str(ask)).otherwise(asked)
        return asked

    data, at6 = F.col("data"), F.col("off_ICMPv6")
    pair6 = lambda i: O.be(data, at6 + i, 2).cast("string")
    wanted = v("ICMPv6.type") == NEIGHBOUR[1 if reverse else 0]
    target = F.when(wanted & (F.col("_stop") - at6 >= 24), F.hex(O.part(data, at6 + 8, 16)))
    dns = F.when(v("DNS.qr") == (1 if reverse else 0), t("DNS.id"))
    arp = F.when(v("ARP.op") == (2 if reverse else 1), joined("arp", *swap(t("ARP.psrc"), t("ARP.pdst"))))
    return (
        F.when(has("TCP"), joined("tcp", *ends, *ports("TCP")))
        .when(has("UDP") & has("DNS"), joined("dns", *ends, *ports("UDP"), dns))
        .when(has("UDP"), joined("udp", *ends, *ports("UDP")))
        .when(has("ICMP"), joined("icmp", by_type(v("ICMP.type"), ICMP_REPLIES), *ends, t("ICMP.id"), t("ICMP.seq")))
        .when(has("ICMPv6"), F.coalesce(joined("icmp6", by_type(v("ICMPv6.type"), ICMP6_REPLIES), *ends, pair6(4), pair6(6)), joined("nd", target)))
        .when(has("ARP"), arp)
    )


def answers(df: DataFrame, lookahead: int | None = None) -> DataFrame:
    """num, answer: every later packet that answers num (a list may consume each several times).

    lookahead: only answers of the next so many numbers; a packet then meets just the answers in its own block of numbers and in the next one,
    and not all of a long conversation.
    """
    d, ready = decoded(df, KEY_FIELDS, KEY_ANCHORS)
    own = of_capture(df)
    asked = d.select(*own, "num", reply_key(False, ready).alias("key")).where("key is not null")
    replied = d.select(*own, F.col("num").alias("answer"), reply_key(True, ready).alias("key")).where("key is not null")
    # frames are larger than the files that they are made of let Spark expect, so it would send a whole side by way of the driver to every task
    if lookahead is None:
        return asked.join(replied.hint("merge"), [*own, "key"]).where("answer > num").select(*own, "num", "answer")
    block = F.floor(F.col("num") / lookahead)
    asked = asked.withColumn("block", F.explode(F.array(block, block + 1)))
    replied = replied.withColumn("block", F.floor(F.col("answer") / lookahead))
    met = asked.join(replied.hint("merge"), [*own, "key", "block"])
    return met.where((F.col("answer") > F.col("num")) & (F.col("answer") <= F.col("num") + lookahead)).select(*own, "num", "answer")


def _keyed(df: DataFrame, slim: bool) -> tuple[DataFrame, bool, Callable[[bool], Column]]:
    d, ready = decoded(df, KEY_FIELDS, KEY_ANCHORS if slim else None)
    own = [F.col(c).cast("string") for c in of_capture(df)]
    return d, ready, lambda reverse: F.when((k := reply_key(reverse, ready)).isNotNull(), F.concat_ws("|", *own, k))


def pairs(df: DataFrame, request: Column | None = None) -> DataFrame:
    """num, answer of the greedy pairing: each request takes the first later answer that none before it took.

    request: which packets ask; the others answer. Within a key the k-th request gets answer number k + max over i <= k of
    (answers before request i, minus i), so two window sums do what a loop over the list would. Without `request` every packet
    may ask and answer, and one that was taken as an answer asks no more: see `paired_once`.
    """
    if request is None:
        return paired_once(df)
    d, _, key = _keyed(df, slim=False)  # what `request` reads isn't known
    both = d.select("num", request.alias("asks"), key(False).alias("ask"), key(True).alias("say"))
    both = both.select("num", F.when(F.col("asks"), F.col("ask")).otherwise(F.col("say")).alias("key"), F.when(F.col("asks"), 0).otherwise(1).alias("reply"))
    w = Window.partitionBy("key").orderBy("num", "reply").rowsBetween(Window.unboundedPreceding, 0)
    both = both.where("key is not null").withColumn("replies", F.sum("reply").over(w)).withColumn("k", F.count("*").over(w) - F.col("replies"))
    lead = both.where("reply = 0").withColumn("place", F.col("k") + F.max(F.col("replies") - F.col("k") + 1).over(w))
    taken = both.where("reply = 1").select("key", F.col("replies").alias("place"), F.col("num").alias("answer"))
    return lead.select("key", "num", "place").join(taken, ["key", "place"]).select("num", "answer")


def _once(batches: Iterator[pd.DataFrame], lookahead: int | None) -> Iterator[pd.DataFrame]:
    """From packets by conversation and num: pairs, each packet in one at most, the first to ask served first."""
    talk, asking = None, {}
    for b in batches:
        rows = []
        for t, num, ask, say in zip(b["talk"], b["num"], b["ask"], b["say"], strict=True):
            if t != talk:
                talk, asking = t, {}
            waiting = asking.get(say) if say is not None else None
            while waiting and lookahead is not None and num - waiting[0] > lookahead:
                waiting.popleft()
            if waiting:
                rows.append((waiting.popleft(), num))
            elif ask is not None:
                asking.setdefault(ask, deque()).append(num)
        yield pd.DataFrame(rows, columns=["num", "answer"])


def paired_once(df: DataFrame, lookahead: int | None = None) -> DataFrame:
    """num, answer where any packet may ask or answer: each takes the first later answer that is free, and both are used up.

    A packet that comes answers the one that has waited longest for it (for `lookahead` numbers at most), else it waits itself. Packets meet by their unordered pair of keys, and a
    task walks them in the order of num and holds the numbers of those that wait.
    """
    d, _, key = _keyed(df, slim=True)
    k = d.select("num", key(False).alias("ask"), key(True).alias("say")).where("ask is not null or say is not null")
    k = k.withColumn("talk", F.least("ask", "say")).repartition("talk").sortWithinPartitions("talk", "num")
    return k.mapInPandas(lambda batches: _once(batches, lookahead), "num bigint, answer bigint")


def unanswered(df: DataFrame, request: Column) -> DataFrame:
    """num of the requests without an answer."""
    return dissect(df).where(request).select("num").join(pairs(df, request), "num", "left_anti")


def quoted() -> dict[str, Column]:
    """The datagram that an ICMP error quotes: src, dst, proto, id."""
    at = F.when(layer_column("ICMP.type").isin(3, 4, 5, 11, 12) & (F.col("end") - F.col("off_ICMP") >= 28), F.col("off_ICMP") + 8)
    data = F.col("data")
    fields = {"src": O.be(data, at + 12, 4), "dst": O.be(data, at + 16, 4), "proto": O.be(data, at + 9, 1), "id": O.be(data, at + 4, 2)}
    return {k: F.when(at.isNotNull(), v) for k, v in fields.items()}


def traceroute(df: DataFrame) -> DataFrame:
    """target, ttl, hop, final: who answered each probe; the earliest answer counts."""
    d = dissect(df)
    errors = d.select(F.col("num").alias("at"), layer_column("IP.src").alias("hop"), (layer_column("ICMP.type") == 3).alias("final"), *[v.alias(f"q_{k}") for k, v in quoted().items()]).where("q_dst is not null")
    ip = lambda n: layer_column(f"IP.{n}")
    probes = d.where(layer_column("UDP") | layer_column("TCP")).select("num", ip("dst").alias("target"), ip("ttl").alias("ttl"), O.be(F.col("data"), F.col("off_IP") + 12, 4).alias("q_src"), O.be(F.col("data"), F.col("off_IP") + 16, 4).alias("q_dst"), ip("proto").alias("q_proto"), ip("id").alias("q_id"))
    met = probes.join(errors, ["q_src", "q_dst", "q_proto", "q_id"]).where("at > num")
    return met.groupBy("target", "ttl").agg(F.min_by(F.struct("hop", "final"), "at").alias("one")).select("target", "ttl", "one.hop", "one.final")


def arping(df: DataFrame) -> DataFrame:
    """ip, mac of the stations that said is-at; the last word counts."""
    d = dissect(df).where(layer_column("ARP.op") == 2)
    return d.groupBy(layer_column("ARP.psrc").alias("ip")).agg(F.max_by(layer_column("ARP.hwsrc"), F.struct("num", layer_column("ARP.hwsrc"))).alias("mac"))


def route(addresses: DataFrame, routes: DataFrame) -> DataFrame:
    """addresses (address bigint, ...) with gateway: longest prefix first, then the least metric; null without a route.

    routes: network bigint, length int, metric int, gateway string. An equi-join on the masked address for each of
    the at most 33 lengths.
    """
    mask = lambda a, n: a - F.pmod(a, F.pow(F.lit(2.0), F.lit(32) - n).cast("bigint"))
    keyed = addresses.select("address").distinct().withColumn("length", F.explode(F.sequence(F.lit(0), F.lit(32)))).withColumn("network", mask(F.col("address"), F.col("length")))
    best = keyed.join(routes, ["network", "length"]).groupBy("address").agg(F.max_by("gateway", F.struct("length", -F.col("metric"))).alias("gateway"))
    return addresses.join(best, "address", "left")
