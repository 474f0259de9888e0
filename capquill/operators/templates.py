"""Packet templates: Cartesian products by arithmetic on an index, and frames from columns."""

from __future__ import annotations

from collections.abc import Sequence
from ipaddress import ip_network
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.functions import octets as O
from capquill.operators.dissect import dissect


def network(spark: SparkSession, cidr: str) -> DataFrame:
    """address, as text, of every address of an IPv4 network."""
    net = ip_network(cidr, strict=False)
    return spark.range(int(net.network_address), int(net.broadcast_address) + 1).select(O.ipv4_text(F.col("id")).alias("address"))


def choices(value) -> list | range:
    """A list as it is, a tuple (low, high) as the inclusive range, anything else alone."""
    if isinstance(value, tuple):
        return range(value[0], value[1] + 1)
    return value if isinstance(value, list | range) else [value]


def product(spark: SparkSession, fields: dict[str, object]) -> DataFrame:
    """index and one column per field; the last declared field is the slowest. Rows are computed from the index, not joined."""
    values = {k: choices(v) for k, v in fields.items()}
    out = spark.range(prod(map(len, values.values()))).withColumnRenamed("id", "index")
    step = 1
    for name, v in values.items():
        digit = F.floor(F.col("index") / step) % len(v)
        out = out.withColumn(name, digit + v.start if isinstance(v, range) else F.element_at(F.array(*map(F.lit, v)), (digit + 1).cast("int")))
        step *= len(v)
    return out


def product_of(df: DataFrame, fields: dict[str, object]) -> DataFrame:
    """df with index and one column per field: the template's product for each row, by arithmetic on the index."""
    values = {name: choices(v) for name, v in fields.items()}
    total, step = 1, {}
    for name, v in values.items():
        step[name], total = total, total * len(v)
    out = df.withColumn("index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(total - 1).cast("bigint"))))

    def value(name: str) -> Column:
        v = values[name]
        at = F.floor(F.col("index") / step[name]) % len(v)
        return (at * v.step + v.start).cast("bigint") if isinstance(v, range) else F.array(*map(F.lit, v))[at.cast("int")]

    return out.select("*", *[value(n).alias(n) for n in values])


def addresses(network: Column, length: Column | int) -> Column:
    """array<bigint> of all addresses of an IPv4 network given as a number, its host bits ignored."""
    size = F.pow(F.lit(2.0), F.lit(32) - length).cast("bigint")
    base = network - F.pmod(network, size)
    return F.sequence(base, base + size - 1)


def ether(kind: int, body: Column, dst: str = "ffffffffffff", src: str = "020000000001", vlan: Column | None = None) -> Column:
    tag = F.lit(b"") if vlan is None else F.when(vlan.isNotNull(), F.concat(F.unhex(F.lit("8100")), O.octets(vlan, 2))).otherwise(F.lit(b""))
    return F.concat(F.unhex(F.lit(dst + src)), tag, O.octets(F.lit(kind), 2), body)


def ipv4(src: Column, dst: Column, proto: Column | int, body: Column, *, ident: Column | int = 0, ttl: Column | int = 64, flags: int = 0) -> Column:
    """An IPv4 datagram with its length and, of zero, its checksum."""
    c = O.as_column
    return F.concat(F.unhex(F.lit("4500")), O.octets(F.length(body) + 20, 2), O.octets(c(ident), 2), O.octets(F.lit(flags), 2), O.octets(c(ttl), 1), O.octets(c(proto), 1), F.lit(b"\0\0"), O.octets(src, 4), O.octets(dst, 4), body)


def ipv6(src: Column, dst: Column, nh: int, body: Column) -> Column:
    return F.concat(F.unhex(F.lit("60000000")), O.octets(F.length(body), 2), O.octets(F.lit(nh), 1), O.octets(F.lit(64), 1), src, dst, body)


def udp(sport: Column | int, dport: Column | int, body: Column) -> Column:
    c = O.as_column
    return F.concat(O.octets(c(sport), 2), O.octets(c(dport), 2), O.octets(F.length(body) + 8, 2), F.lit(b"\0\0"), body)


def tcp(sport: Column | int, dport: Column | int, seq: Column | int, flags: Column | int, body: Column, ack: Column | int = 0) -> Column:
    c = O.as_column
    return F.concat(O.octets(c(sport), 2), O.octets(c(dport), 2), O.octets(c(seq), 4), O.octets(c(ack), 4), F.unhex(F.lit("50")), O.octets(c(flags), 1), F.unhex(F.lit("200000000000")), body)


def icmp(kind: Column | int, code: int, ident: Column | int, seq: Column | int, body: Column) -> Column:
    c = O.as_column
    return F.concat(O.octets(c(kind), 1), O.octets(F.lit(code), 1), F.lit(b"\0\0"), O.octets(c(ident), 2), O.octets(c(seq), 2), body)


def arp(op: Column | int, hwsrc: Column, psrc: Column, hwdst: Column, pdst: Column) -> Column:
    return F.concat(F.unhex(F.lit("000108000604")), O.octets(O.as_column(op), 2), hwsrc, O.octets(psrc, 4), hwdst, O.octets(pdst, 4))


def concat_captures(parts: Sequence[DataFrame]) -> DataFrame:
    """All packets of the captures, with `part` to tell them apart; nothing is dropped."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def random_number(seed: int, low: int, high: int, *by: str) -> Column:
    """An integer of [low, high], drawn by the seed and the row's values of `by`: the same again in every run."""
    return F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(high - low + 1))


def random_ipv4(seed: int, cidr: str, *by: str) -> Column:
    net = ip_network(cidr, strict=False)
    return O.ipv4_text(random_number(seed, int(net.network_address), int(net.broadcast_address), *by))


def random_mac(seed: int, *by: str) -> Column:
    """A locally administered unicast address."""
    return O.mac_text(O.octets(random_number(seed, 0, (1 << 40) - 1, *by).bitwiseOR(0x02 << 40), 6))


def random_choice(seed: int, values: Sequence, *by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), random_number(seed, 1, len(values), *by).cast("int"))


def random_octets(seed: int, n: Column | int, *by: str) -> Column:
    """n octets, a SHA-256 block at a time."""
    draw = lambda i: F.sha2(F.concat_ws(",", F.lit(str(seed)), i.cast("string"), *[F.col(c).cast("string") for c in by]), 256)
    if isinstance(n, int) and n <= 32:  # a lambda isn't compiled
        return O.part(F.unhex(draw(F.lit(1))), 0, n)
    blocks = F.ceil(O.as_column(n) / 32).cast("int")
    return O.part(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(blocks, F.lit(1))), draw), "")), 0, n)


def corrupt(data: Column, seed: int, *by: str, bits: int = 1) -> Column:
    """Octets with `bits` bits flipped (fewer if one is drawn twice), the places drawn by the seed and the values of `by`; empty octets stay."""
    out = data
    for k in range(bits):
        at = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *by), F.greatest(F.length(data) * 8, F.lit(1)))
        octet = F.floor(at / 8).cast("int")
        flipped = O.octets(O.number(O.part(out, octet, 1)).bitwiseXOR(F.pow(F.lit(2.0), at % 8).cast("bigint")), 1)
        out = F.when(F.length(data) > 0, F.concat(O.part(out, 0, octet), flipped, O.part(out, octet + 1, F.length(data)))).otherwise(data)
    return out


def sized(data: Column, most: int = 65535) -> Column:
    """The octets; a query over ones that no length field of up to `most` can hold fails."""
    return F.when(F.length(data) > most, F.raise_error(F.concat(F.lit("no length field holds "), F.length(data).cast("string"), F.lit(" octets")))).otherwise(data)


def ipv6_fragments(df: DataFrame, size: int = 1232) -> DataFrame:
    """num, piece, data: IPv6 datagrams over Ethernet in fragments of at most `size` octets behind a fragment header, by num as ident; what fits stays."""
    unit = size // 8 * 8
    d = dissect(df).where(F.col("off_IPv6").isNotNull())
    at, data = F.col("off_IPv6"), F.col("data")
    length = F.col("end") - at - 40
    d = d.select("num", "data", at.alias("at"), length.alias("length"), F.when(length <= size, 1).otherwise(F.ceil(length / unit)).cast("int").alias("pieces"))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    body = O.part(data, F.col("at") + 40 + F.col("piece") * unit, F.least(F.lit(unit), F.col("length") - F.col("piece") * unit))
    more = F.when(F.col("piece") < F.col("pieces") - 1, 1).otherwise(0)
    head = F.concat(O.part(data, F.col("at") + 6, 1), F.lit(b"\0"), O.octets(F.col("piece") * unit + more, 2), O.octets(F.col("num").bitwiseAND((1 << 32) - 1), 4))
    fixed = F.concat(O.part(data, 0, F.col("at") + 4), O.octets(F.length(body) + 8, 2), F.unhex(F.lit("2c")), O.part(data, F.col("at") + 7, 33))
    return d.select("num", "piece", F.when(F.col("pieces") > 1, F.concat(fixed, head, body)).otherwise(data).alias("data"))
