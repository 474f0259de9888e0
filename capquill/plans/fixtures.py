"""Captures made from the driver's tables: frames are built by expressions, so every query has SQL over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.functions import octets as O
from capquill.operators import templates as T
from capquill.operators.dissect import capture
from capquill.operators.records import dns_encoded, dns_message


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(second: int, key: str):
    """10.<second>.x.y of the low 16 bits of a key, as an integer."""
    return (F.lit((10 << 24) + (second << 16)) + F.col(key).bitwiseAND(65535)).cast("bigint")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed capture of lineitem: ARP, ICMP echo, UDP over IPv6, UDP, TCP (some with a VLAN tag); ARP is padded."""
    li = table(spark, sf_dir, "lineitem")
    src, dst, line = address(0, "l_suppkey"), address(1, "l_partkey"), F.col("l_linenumber")
    sport = (F.col("l_orderkey") % 60000 + 1024).cast("bigint")
    mac = lambda key: F.concat(F.unhex(F.lit("0200")), F.unhex(F.lpad(F.hex(key.cast("bigint")), 8, "0")))
    six = lambda key: F.concat(F.unhex(F.lit("20010db8" + "0" * 20)), F.unhex(F.lpad(F.hex(F.col(key).bitwiseAND(65535)), 4, "0")))
    body = F.encode(F.concat(F.col("l_returnflag"), F.col("l_linestatus")), "UTF-8")
    ident, ttl = F.col("l_orderkey").bitwiseAND(65535), line + 60
    vlan = F.when(line == 5, F.col("l_quantity").cast("bigint"))
    arp = F.concat(T.ether(0x0806, T.arp(F.when(F.col("l_returnflag") == "R", 2).otherwise(1), mac(F.col("l_suppkey")), src, mac(F.col("l_partkey")), dst)), F.lit(b"\0" * 18))
    icmp = T.ether(0x0800, T.ipv4(src, dst, 1, T.icmp(F.when(F.col("l_returnflag") == "R", 0).otherwise(8), 0, ident, line, body), ident=ident, ttl=ttl))
    udp6 = T.ether(0x86DD, T.ipv6(six("l_suppkey"), six("l_partkey"), 17, T.udp(sport, 80, body)))
    udp = T.ether(0x0800, T.ipv4(src, dst, 17, T.udp(sport, 80, body), ident=ident, ttl=ttl), vlan=vlan)
    tcp = T.ether(0x0800, T.ipv4(src, dst, 6, T.tcp(sport, 80, F.col("l_partkey"), F.when(F.col("l_linestatus") == "O", 2).otherwise(18), F.lit(b"")), ident=ident, ttl=ttl), vlan=vlan)
    data = F.when(line == 7, arp).when(line == 6, icmp).when(line == 4, udp6).when(F.col("l_returnflag") == "R", udp).otherwise(tcp)
    time = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000.0
    return capture(li.select((F.col("l_orderkey") * 8 + line).alias("num"), time.alias("time"), data.alias("data")))


#: The same capture as columns, for the SQL of the queries; `p` is what each of them starts with.
PACKETS_SQL = """
WITH p0 AS (
  SELECT *, l_orderkey * 8 + l_linenumber AS num, epoch_us(l_shipdate) / 1000000.0 AS time,
         CASE WHEN l_linenumber = 7 THEN 'ARP' WHEN l_linenumber = 6 THEN 'ICMP' WHEN l_linenumber = 4 THEN 'UDP6' WHEN l_returnflag = 'R' THEN 'UDP' ELSE 'TCP' END AS kind,
         '10.0.' || ((l_suppkey & 65535) >> 8) || '.' || (l_suppkey & 255) AS src4, '10.1.' || ((l_partkey & 65535) >> 8) || '.' || (l_partkey & 255) AS dst4,
         '2001:db8::' || CASE WHEN l_suppkey & 65535 = 0 THEN '' ELSE lower(printf('%x', l_suppkey & 65535)) END AS src6,
         '2001:db8::' || CASE WHEN l_partkey & 65535 = 0 THEN '' ELSE lower(printf('%x', l_partkey & 65535)) END AS dst6
  FROM lineitem
), p AS (
  SELECT num, time, kind, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_shipdate,
         CASE WHEN kind IN ('TCP', 'UDP', 'ICMP') THEN src4 END AS ip_src, CASE WHEN kind IN ('TCP', 'UDP', 'ICMP') THEN dst4 END AS ip_dst,
         CASE WHEN kind = 'UDP6' THEN src6 END AS ip6_src, CASE WHEN kind = 'UDP6' THEN dst6 END AS ip6_dst,
         CASE WHEN kind = 'ARP' THEN src4 END AS arp_src, CASE WHEN kind = 'ARP' THEN dst4 END AS arp_dst,
         CASE kind WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 END AS proto,
         CASE WHEN kind IN ('TCP', 'UDP', 'UDP6') THEN l_orderkey % 60000 + 1024 END AS sport, CASE WHEN kind IN ('TCP', 'UDP', 'UDP6') THEN 80 END AS dport,
         CASE WHEN kind = 'TCP' THEN CASE WHEN l_linestatus = 'O' THEN 'S' ELSE 'SA' END END AS tcp_flags,
         CASE WHEN kind IN ('TCP', 'UDP', 'ICMP') THEN l_linenumber + 60 END AS ttl,
         CASE WHEN l_linenumber = 5 THEN CAST(l_quantity AS BIGINT) END AS vlan,
         CASE kind WHEN 'ARP' THEN 60 WHEN 'ICMP' THEN 44 WHEN 'UDP6' THEN 64 WHEN 'UDP' THEN 44 ELSE 54 END + CASE WHEN l_linenumber = 5 THEN 4 ELSE 0 END AS len
  FROM p0
)
"""


#: Octets of a text in one datagram, and the factor from doc_id to the numbers of a document's datagrams.
DATAGRAM, DATAGRAMS = 60000, 1 << 16


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDP datagrams of each text of documents, as many as it needs: of num, the high bits are doc_id and the low 16 the place in the text.

    The IP ident is the low 16 bits, the addresses hold 48 bits of doc_id, so no two datagrams share a fragment key.
    """
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("body") - 1, F.lit(0)) / DATAGRAM).cast("int"))))
    low, high = F.col("doc_id").bitwiseAND((1 << 24) - 1), F.shiftright("doc_id", 24).bitwiseAND((1 << 24) - 1)
    piece = F.substring("body", F.col("k") * DATAGRAM + 1, F.lit(DATAGRAM))
    frame = T.ether(0x0800, T.ipv4(low + (10 << 24), high + (11 << 24), 17, T.udp(F.lit(9), F.lit(9), piece), ident=F.col("k")))
    return capture(d.select((F.col("doc_id") * DATAGRAMS + F.col("k")).alias("num"), frame.alias("data")))


def datagrams_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UDP datagram over IPv6 of the name and balance of each customer, repeated to a length of its key."""
    c = table(spark, sf_dir, "customer")
    end = lambda k: F.concat(F.unhex(F.lit("20010db8" + "0" * 6 + k)), O.octets(F.col("c_custkey"), 8))
    body = F.encode(F.repeat("c_name", (F.col("c_custkey") % 400 + 1).cast("int")), "UTF-8")
    return capture(c.select(F.col("c_custkey").alias("num"), T.ether(0x86DD, T.ipv6(end("01"), end("02"), 17, T.udp(9, 9, body))).alias("data")))


def optioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SYN of each line item, with the options MSS, SAckOK, Timestamp, NOP and WScale, in a frame with IP flags."""
    li = table(spark, sf_dir, "lineitem")
    options = F.concat(F.unhex(F.lit("0204")), O.octets(F.col("l_quantity").cast("bigint") + 1000, 2), F.unhex(F.lit("0402080a")), O.octets(stamp_ms(F.col("l_linenumber"), F.col("l_orderkey")), 4), F.unhex(F.lit("0000000001030303")))
    options = F.concat(O.part(options, 0, 19), O.octets(F.col("l_linenumber"), 1))
    segment = F.concat(O.octets(F.col("l_orderkey") % 60000 + 1024, 2), O.octets(F.lit(443), 2), O.octets(F.col("l_partkey"), 4), F.unhex(F.lit("00000000a1022000" + "0" * 8)), options)
    flags = F.when(F.col("l_returnflag") == "R", 0x4000).when(F.col("l_returnflag") == "A", 0x8000).otherwise(0)
    datagram = T.ipv4(address(0, "l_suppkey"), address(1, "l_partkey"), 6, segment, ident=F.col("l_linenumber"))
    datagram = F.concat(O.part(datagram, 0, 6), O.octets(flags, 2), O.part(datagram, 8, 1 << 16))
    time = F.col("l_orderkey") + F.col("l_linenumber") / 8.0
    return capture(li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("num"), time.alias("time"), T.ether(0x0800, datagram).alias("data")))


def stamp_ms(line, order):
    """A sender's clock in milliseconds, of 32 bits."""
    return (order * 1000 + line * 130).bitwiseAND((1 << 32) - 1)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DNS answer of each order: its name, an A record by a pointer to the name, and a TXT record."""
    o = table(spark, sf_dir, "orders")
    word = lambda text: F.concat(O.octets(F.octet_length(text), 1), F.encode(text, "UTF-8"))
    name = dns_encoded(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit("."), F.col("o_orderstatus"), F.lit(".example")))
    pointer = F.unhex(F.lit("c00c"))
    a = F.concat(pointer, F.unhex(F.lit("00010001")), O.octets(F.col("o_custkey"), 4), F.unhex(F.lit("0004")), O.octets(address(9, "o_custkey"), 4))
    txt = F.concat(pointer, F.unhex(F.lit("0010000100000007")), O.octets(F.octet_length("o_orderpriority") + 1, 2), word(F.col("o_orderpriority")))
    message = F.concat(O.octets(F.col("o_orderkey").bitwiseAND(65535), 2), F.unhex(F.lit("81800001000100000001")), name, F.unhex(F.lit("00010001")), a, txt)
    frame = T.ether(0x0800, T.ipv4(F.lit(167772161), address(2, "o_orderkey"), 17, T.udp(53, 4000, message)))
    return capture(o.select(F.col("o_orderkey").alias("num"), frame.alias("data")))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A RIP response of each line item with as many entries as its number; every third one claims more than it has."""
    li = table(spark, sf_dir, "lineitem")
    entry = lambda i: F.concat(F.unhex(F.lit("00020000")), O.octets(F.lit(10 << 24) + i * 65536, 4), F.unhex(F.lit("ffff000000000000")), O.octets(i + F.col("l_quantity").cast("bigint"), 4))
    entries = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), entry), F.lit(b""), lambda a, x: F.concat(a, x))
    frame = T.ether(0x0800, T.ipv4(address(0, "l_suppkey"), address(1, "l_partkey"), 17, T.udp(520, 520, F.concat(F.unhex(F.lit("02020000")), entries))))
    return capture(li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("num"), frame.alias("data")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DNS-like request of each order and a reply of each returned line of it, with the ends swapped."""
    port = lambda key: (F.col(key) % 60000 + 1024).cast("bigint")
    server = F.lit((10 << 24) + (3 << 16) + 1).cast("bigint")
    o = table(spark, sf_dir, "orders")
    ask = o.select((F.col("o_orderkey") * 16).alias("num"), T.ether(0x0800, T.ipv4(address(2, "o_orderkey"), server, 17, T.udp(port("o_orderkey"), 53, F.lit(b"")))).alias("data"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    say = li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("num"), T.ether(0x0800, T.ipv4(server, address(2, "l_orderkey"), 17, T.udp(F.lit(53), port("l_orderkey"), F.lit(b"")))).alias("data"))
    return capture(ask.unionByName(say))


#: Address of the server that conversations 0 to 65,535 talk to.
SERVERS = 11 << 24


def chat(spark: SparkSession, sf_dir: str, size: int = 512, six: bool = False, record: bool = False) -> DataFrame:
    """TCP segments of at most `size` octets of conversations: the user is the client, all other roles are the server; numbers run on per direction.

    six: over IPv6; record: each turn is a TLS record. The low 16 bits of conv_id are in the client's address and the rest in the server's, so no two conversations share a stream.
    """
    from pyspark.sql import Window

    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    body = F.concat(F.unhex(F.lit("170303")), O.octets(F.length(body), 2), body) if record else body
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.col("role") == "user", F.lit(False)).alias("mine"), body.alias("body"))
    before = Window.partitionBy("conv_id", "mine").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("seq", F.coalesce(F.sum(F.length("body")).over(before), F.lit(0)) + 1000)
    c = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("body") - 1, F.lit(0)) / size).cast("int"))))
    piece, mine = F.substring("body", F.col("k") * size + 1, F.lit(size)), F.col("mine")
    port = (F.col("conv_id") % 60000 + 1024).cast("bigint")
    segment = T.tcp(F.when(mine, port).otherwise(80), F.when(mine, F.lit(80)).otherwise(port), F.col("seq") + F.col("k") * size, F.lit(24), piece)
    if six:
        client, server = F.concat(F.unhex(F.lit("20010db8" + "0" * 8)), O.octets(F.col("conv_id"), 8)), F.unhex(F.lit("20010db9" + "0" * 23 + "1"))
        frame = T.ether(0x86DD, T.ipv6(F.when(mine, client).otherwise(server), F.when(mine, server).otherwise(client), 6, segment))
    else:
        client, server = address(5, "conv_id"), F.shiftright("conv_id", 16) + SERVERS
        frame = T.ether(0x0800, T.ipv4(F.when(mine, client).otherwise(server), F.when(mine, server).otherwise(client), 6, segment))
    return capture(c.select((F.col("conv_id") * 1_000_000 + F.col("turn") * 1000 + F.col("k")).alias("num"), frame.alias("data")))


def web(spark: SparkSession, sf_dir: str, size: int = 1400) -> DataFrame:
    """An HTTP response of each page, in segments sent out of order and with one repeated.

    The low 16 bits of page_id are in the sender's address, the next 24 in the other's and the rest in its port.
    """
    p = table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    message = F.concat(F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Length: "), F.length("html").cast("string"), F.lit("\r\n\r\n")), "UTF-8"), F.col("html"))
    p = p.select("page_id", message.alias("m"))
    p = p.withColumn("k", F.explode(F.concat(F.sequence(F.lit(0), F.floor((F.length("m") - 1) / size).cast("int")), F.array(F.lit(0)))))
    order = F.when(F.col("k") == 0, 0).otherwise((1 << 20) - F.col("k"))
    other, port = F.shiftright("page_id", 16).bitwiseAND((1 << 24) - 1) + (11 << 24), F.shiftright("page_id", 40) + 5000
    frame = T.ether(0x0800, T.ipv4(address(7, "page_id"), other, 6, T.tcp(F.lit(80), port, F.col("k") * size + 7, F.lit(24), F.substring("m", F.col("k") * size + 1, F.lit(size)))))
    return capture(p.select((F.col("page_id") * (1 << 20) + order).alias("num"), frame.alias("data")))


def tunnelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each packet of `packets` in a tunnel by its line: VXLAN, GRE (with a key and without), Geneve with an option, GTP-U with an extension header, PPPoE."""
    p = packets(spark, sf_dir)
    data, line, key = F.col("data"), F.col("num").bitwiseAND(7), F.shiftright("num", 3).bitwiseAND((1 << 16) - 1)
    over = lambda proto, body: T.ether(0x0800, T.ipv4(F.lit(1 << 24), F.lit(2 << 24), proto, body))
    hexed = lambda text: F.unhex(F.lit(text))
    bare = O.part(data, 14, 1 << 16)
    vxlan = over(17, T.udp(40000, 4789, F.concat(hexed("08000000"), O.octets(key, 3), hexed("00"), data)))
    gre = F.concat(F.when(line == 2, F.concat(hexed("20006558"), O.octets(key, 4))).otherwise(hexed("00006558")), data)
    geneve = over(17, T.udp(40000, 6081, F.concat(hexed("02006558"), O.octets(key, 3), hexed("00" + "01020301" + "0a0b0c0d"), data)))
    gtp = over(17, T.udp(40000, 2152, F.concat(hexed("34ff"), O.octets(F.length(bare) + 8, 2), O.octets(key, 4), hexed("00000085" + "01000000"), bare)))
    pppoe = T.ether(0x8864, F.concat(hexed("1100"), O.octets(key, 2), O.octets(F.length(bare) + 2, 2), hexed("0021"), bare, hexed("00" * 9)))
    outer = F.when(line.isin(2, 7), over(47, gre)).when(line == 3, geneve).when(line == 4, gtp).when(line == 6, pppoe).otherwise(vxlan)
    return capture(p.select("num", "time", outer.alias("data")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untagged IP packets of `packets` on other links than Ethernet, by their line."""
    p = packets(spark, sf_dir)
    line, bare = F.col("num").bitwiseAND(7), O.part(F.col("data"), 14, 1 << 16)
    hexed = lambda text: F.unhex(F.lit(text))
    cooked = F.concat(hexed("000000010006" + "0200000000010000" + "0800"), bare)
    cooked2 = F.concat(hexed("86dd" + "0000" + "00000003" + "0001" + "00" + "06" + "0200000000010000"), bare)
    data = F.when(line == 1, F.concat(hexed("02000000"), bare)).when(line == 2, cooked).when(line == 4, cooked2).when(line == 6, F.concat(hexed("00000002"), bare)).otherwise(bare)
    kind = F.when(line == 1, 0).when(line == 2, 113).when(line == 4, 276).when(line == 6, 108).otherwise(101)
    return capture(p.where(~line.isin(5, 7)).select("num", "time", data.alias("data"), kind.cast("int").alias("linktype")))


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of `packets` with more layers below, by their line: three VLAN tags, two MPLS labels, two more IP headers, IPv6 extension headers, an authentication header, VXLAN."""
    p = packets(spark, sf_dir)
    data, line = F.col("data"), F.col("num").bitwiseAND(7)
    hexed = lambda text: F.unhex(F.lit(text))
    macs, bare = hexed("ffffffffffff020000000001"), O.part(data, 14, 1 << 16)
    tags = F.concat(macs, hexed("88a80064" + "8100" + "00c8" + "8100" + "012c" + "0800"), bare)
    labels = F.concat(macs, hexed("8847" + "00064040" + "000c8140"), bare)
    over = lambda second, body: T.ipv4(F.lit((second << 24) + 1), F.lit((second << 24) + 2), 4, body)
    nested = T.ether(0x0800, over(1, over(2, bare)))
    six = O.part(data, 14, 40)
    longer = F.concat(O.part(six, 0, 4), O.octets(F.length(bare) - 40 + 24, 2), hexed("00"), O.part(six, 7, 33))
    extended = F.concat(macs, hexed("86dd"), longer, hexed("3c00" + "0" * 12 + "2c00" + "0" * 12 + "1100" + "0000" + "00000007"), O.part(bare, 40, 1 << 16))
    inner = O.part(data, 18, 1 << 16)
    header, length = O.part(inner, 0, 20), F.length(inner) + 24
    behind = F.concat(O.part(inner, 9, 1), hexed("04" + "0000" + "00000009" + "00000001" + "0" * 24), O.part(inner, 20, 1 << 16))
    signed = F.concat(macs, hexed("0800"), O.part(header, 0, 2), O.octets(length, 2), O.part(header, 4, 5), hexed("33"), O.part(header, 10, 10), behind)
    vxlan = T.ether(0x0800, T.ipv4(F.lit(1 << 24), F.lit(2 << 24), 17, T.udp(40000, 4789, F.concat(hexed("0800000000000500"), data))))
    frame = F.when(line == 1, tags).when(line == 2, labels).when(line == 3, nested).when(line == 4, extended).when(line == 5, signed).when(line == 6, vxlan).otherwise(data)
    return capture(p.select("num", "time", frame.alias("data")))


#: Octets from one segment of a long stream to the next.
STRIDE = 1_500_000_000


def long_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direction of each supplier whose line items are segments of five octets, STRIDE octets apart, every fourth sent again later."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("num")).distinct()
    li = li.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("num")) - 1)
    k = F.col("k").cast("bigint")
    seq = F.pmod(k * STRIDE + 4_000_000_000, F.lit(1 << 32))
    again = F.when(k % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    s = li.select("l_suppkey", "num", seq.alias("seq"), F.explode(again).alias("copy"))
    frame = T.ether(0x0800, T.ipv4(address(0, "l_suppkey"), F.lit(9 << 24), 6, T.tcp(F.lit(1000), F.lit(80), F.col("seq"), F.lit(16), F.lit(b"abcde"))))
    return capture(s.select((F.col("num") * 2 + F.col("copy")).alias("num"), frame.alias("data")))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TCP segment over IPv6 of each line item between two hosts of its order, to and fro by the return flag; all orders use the same ports."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_partkey").alias("l_partkey"))
    host = lambda k: F.concat(F.unhex(F.lit("20010db8" + "0" * 6 + k)), O.octets(F.col("l_orderkey"), 8))
    back = F.col("l_returnflag") == "R"
    a, b = F.when(back, host("02")).otherwise(host("01")), F.when(back, host("01")).otherwise(host("02"))
    segment = T.tcp(F.when(back, 80).otherwise(1000), F.when(back, 1000).otherwise(80), F.col("l_partkey"), F.lit(24), F.lit(b"."))
    return capture(li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("num"), T.ether(0x86DD, T.ipv6(a, b, 6, segment)).alias("data")))


def zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num, message: a DNS answer of each customer with compressed names: a question, an address, a mail server, a signed delegation and a list of types."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("c"), key, F.lit(".n"), F.col("c_nationkey").cast("string"), F.lit(".example."))
    record = lambda section, kind, data, of=name: F.struct(
        F.lit(section).alias("section"), of.alias("name"), F.lit(kind).alias("type"), F.lit(1).cast("bigint").alias("class"),
        F.lit(None if section == "qd" else 300).cast("bigint").alias("ttl"), data.cast("string").alias("data"),
    )
    rows = F.array(
        record("qd", "A", F.lit(None)),
        record("an", "A", O.ipv4_text(address(8, "c_custkey"))),
        record("an", "MX", F.concat(F.lit("10 mail."), name)),
        record("ns", "NSEC", F.concat(F.lit("next."), name, F.lit(" A MX RRSIG TYPE1234"))),
        record("ar", "TXT", F.concat(F.lit("segment "), F.col("c_mktsegment")), F.concat(F.lit("txt."), name)),
    )
    return c.select(F.col("c_custkey").alias("num"), dns_message(rows, F.col("c_custkey").bitwiseAND(65535)).alias("message"))


def zone_over_tcp(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    """The messages of `zone` over a TCP stream of each nation, with their lengths, in segments of at most `size` octets."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("num"), "c_nationkey")
    m = zone(spark, sf_dir).join(c, "num").select("c_nationkey", "num", F.concat(O.octets(F.length("message"), 2), F.col("message")).alias("m"))
    before = Window.partitionBy("c_nationkey").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(F.length("m")).over(before), F.lit(0)))
    m = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("m") - 1) / size).cast("int"))))
    piece = F.substring("m", F.col("k") * size + 1, F.lit(size))
    segment = T.tcp(F.lit(53), F.lit(4000), F.col("at") + F.col("k") * size + 1, F.lit(24), piece)
    frame = T.ether(0x0800, T.ipv4(address(9, "c_nationkey"), F.lit(1 << 24), 6, segment))
    return capture(m.select((F.col("num") * 1000 + F.col("k")).alias("num"), frame.alias("data")))


def managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An SNMP response of each supplier over UDP: its name, its key as a counter, and its nation as an integer."""
    s = table(spark, sf_dir, "supplier")
    hexed = lambda t: F.unhex(F.lit(t))
    of = lambda tag, *parts: F.concat(hexed(tag), O.octets(F.length(F.concat(*parts)), 1), *parts)
    column = lambda k: hexed("06092b060102010202010" + k)  # noqa: E731, 1.3.6.1.2.1.2.2.1.k
    bindings = of(
        "30",
        of("30", column("2"), of("04", F.encode("s_name", "UTF-8"))),
        of("30", column("5"), of("41", O.octets(F.col("s_suppkey"), 4))),
        of("30", column("8"), of("02", O.octets(F.col("s_nationkey"), 1))),
    )
    pdu = of("a2", of("02", O.octets(F.col("s_suppkey"), 4)), hexed("020100" + "020100"), bindings)
    message = of("30", hexed("020101"), of("04", F.lit(b"public")), pdu)
    frame = T.ether(0x0800, T.ipv4(address(0, "s_suppkey"), F.lit(1 << 24), 17, T.udp(161, 4000, message)))
    return capture(s.select(F.col("s_suppkey").alias("num"), frame.alias("data")))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message of each customer over UDP: a counted list of orders, each a counted list of lines of different lengths."""
    line = F.concat(
        O.octets(F.col("l_linenumber"), 1),
        O.octets(F.col("l_linenumber") % 4, 1),
        F.encode(F.expr("repeat(l_linestatus, l_linenumber % 4)"), "UTF-8"),
        O.octets(F.ascii("l_returnflag"), 1),
        F.when(F.col("l_returnflag") == "R", O.octets(F.col("l_suppkey"), 4)).otherwise(F.lit(b"")),
    )
    together = lambda c: F.unhex(F.array_join(F.collect_list(F.hex(c)), ""))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), together(line).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    order = F.concat(O.octets(F.col("o_orderkey"), 4), O.octets(F.col("n"), 2), "lines")
    c = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), together(order).alias("orders"))
    message = F.concat(F.lit(b"\x53"), O.octets(F.col("o_custkey"), 4), O.octets(F.col("n"), 2), "orders")
    frame = T.ether(0x0800, T.ipv4(address(0, "o_custkey"), F.lit(1 << 24), 17, T.udp(4000, 4001, message)))
    return capture(c.select(F.col("o_custkey").alias("num"), F.lit(0.0).alias("time"), frame.alias("data")))
