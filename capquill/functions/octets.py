"""Expressions over BINARY columns: integers, addresses and checksums, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(v: Column | int | str) -> Column:
    return F.lit(v) if isinstance(v, int) else F.col(v) if isinstance(v, str) else v


def part(data: Column, offset: Column | int, n: Column | int) -> Column:
    """n octets from the 0-based offset; shorter at the end of the data."""
    return F.substring(data, as_column(offset) + 1, as_column(n))


def number(octets: Column) -> Column:
    """Big-endian unsigned integer of up to 7 octets; 0 without octets."""
    return F.coalesce(F.conv(F.hex(octets), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def be(data: Column, offset: Column | int, n: int) -> Column:
    """Big-endian unsigned integer at an offset; 0 if it isn't wholly there."""
    return F.when(F.length(data) >= as_column(offset) + n, number(part(data, offset, n))).otherwise(0).cast("bigint")


def bits(data: Column, base: Column | int, bit: int, width: int) -> Column:
    """An unsigned bit field, counted from the most significant bit of the octet at base."""
    first, last = bit // 8, (bit + width - 1) // 8
    value = be(data, as_column(base) + first, last - first + 1)
    value = F.shiftright(value, 8 * (last + 1) - bit - width)
    return value.bitwiseAND((1 << width) - 1) if width < 63 else value


def octets(value: Column, n: int) -> Column:
    """An integer as n big-endian octets."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def ipv4_text(value: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(value, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ipv4_number(text: Column) -> Column:
    """Integer of a dotted quad; null for other text."""
    ok = text.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$") & ~text.endswith(".")
    p = F.split(text, r"\.")
    value = sum((F.try_element_at(p, F.lit(i + 1)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(ok, value)


def mac_text(data: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_replace(F.hex(data), "(..)", "$1:")), F.lit(":"))


def ipv6_text(data: Column) -> Column:
    """Text of 16 octets: lower case, no leading zeros, the first longest run of zero groups as `::`."""
    groups = F.regexp_replace(F.regexp_replace(F.lower(F.hex(data)), "(.{4})", ":$1"), ":0{1,3}(?=[0-9a-f])", ":")

    def shortened(g: Column) -> Column:
        out = g
        for k in range(2, 9):  # the longest run decides, so it is tried last
            out = F.when(g.rlike(f":(?:0:){{{k}}}"), F.regexp_replace(g, f"^(.*?):(?:0:){{{k}}}(.*)$", "$1::$2")).otherwise(out)
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    return F.transform(F.array(F.concat(groups, F.lit(":"))), shortened)[0]


def fold(total: Column) -> Column:
    """One's complement of a sum of 16-bit words, folded to 16 bits; sums of up to 47 bits."""
    for _ in range(3):
        total = F.shiftright(total, 16) + total.bitwiseAND(0xFFFF)
    return F.lit(0xFFFF).cast("bigint") - total


def word_sum(data: Column) -> Column:
    """Sum of the 16-bit words of octets of any length, an odd last one padded with zero."""
    h = F.hex(data)
    h = F.when(F.length(data) % 2 == 1, F.concat(h, F.lit("00"))).otherwise(h)
    starts = F.sequence(F.lit(0), F.greatest(F.length(h) / 4 - 1, F.lit(0)).cast("int"))
    words = F.transform(starts, lambda i: F.coalesce(F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"), F.lit(0).cast("bigint")))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, b: a + b)


def internet_checksum(data: Column) -> Column:
    """RFC 1071 checksum of octets of any length."""
    return fold(word_sum(data))


def fletcher16(data: Column) -> Column:
    h = F.hex(data)
    values = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))

    def add(s: Column, v: Column) -> Column:
        a = (s["a"] + v) % 255
        return F.struct(a.alias("a"), ((s["b"] + a) % 255).alias("b"))

    end = F.aggregate(values, start, add)
    return F.when(F.length(data) == 0, F.lit(0).cast("bigint")).otherwise(end["b"] * 256 + end["a"])


def prefix_mask(length: Column) -> Column:
    """Netmask of a prefix length as an integer."""
    return F.lit(1 << 32).cast("bigint") - F.pow(F.lit(2.0), F.lit(32) - length).cast("bigint")


def in_network(value: Column, network: int, length: int) -> Column:
    return F.shiftright(value, 32 - length) == (network >> (32 - length))


def hexdump_line(data: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 ")))


def from_hexdump(text: Column) -> Column:
    """Octets of a textual dump of hex pairs, blanks ignored; null if it isn't one."""
    return F.unhex(F.regexp_replace(text, r"\s+", ""))


def ipv6_octets(text: Column) -> Column:
    """16 octets of an IPv6 address in hex groups, with or without `::`; null for other text."""
    sides = F.split(text, "::")
    groups = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.try_element_at(sides, F.lit(1))), groups(F.try_element_at(sides, F.lit(2)))
    gap = F.lit(8) - F.size(left) - F.size(right)
    cut = F.size(sides) == 2
    zeros = F.when(cut & (gap > 0), F.array_repeat(F.lit("0"), gap)).otherwise(F.array().cast("array<string>"))
    whole = F.concat(left, zeros, right)
    good = (F.size(sides) <= 2) & (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & ~text.rlike("(^:[^:])|([^:]:$)|:::")
    return F.when(good, F.unhex(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))


def eui64(mac: Column) -> Column:
    """Interface identifier of a MAC address of 6 octets."""
    return F.concat(octets(number(part(mac, 0, 1)).bitwiseXOR(2), 1), part(mac, 1, 2), F.unhex(F.lit("fffe")), part(mac, 3, 3))


def solicited_node(address: Column) -> Column:
    """Solicited-node multicast address of 16 octets."""
    return F.concat(F.unhex(F.lit("ff02" + "0" * 19 + "1ff")), part(address, 13, 3))


def sixtofour(ipv4: Column) -> Column:
    """6to4 prefix 2002:a.b.c.d::/48 of an IPv4 address as an integer, as 16 octets."""
    return F.concat(F.unhex(F.lit("2002")), octets(ipv4, 4), F.unhex(F.lit("0" * 20)))


def ipv6_kind(address: Column) -> Column:
    """unspecified, loopback, multicast, link-local, site-local, unique-local, 6to4, teredo or global."""
    h = F.lower(F.hex(address))
    word = number(part(address, 0, 2))
    return (
        F.when(h == "0" * 32, "unspecified").when(h == "0" * 31 + "1", "loopback").when(h.startswith("ff"), "multicast")
        .when(word.bitwiseAND(0xFFC0) == 0xFE80, "link-local").when(word.bitwiseAND(0xFFC0) == 0xFEC0, "site-local").when(word.bitwiseAND(0xFE00) == 0xFC00, "unique-local")
        .when(word == 0x2002, "6to4").when(h.startswith("20010000"), "teredo").when(address.isNotNull(), "global")
    )


def human_size(n: Column) -> Column:
    """Octets as K, M, G or T of 1024, one decimal."""
    out = n.cast("string")
    for k, unit in enumerate("KMGT", 1):
        out = F.when(n >= 1 << 10 * k, F.concat(F.format_string("%.1f", n / float(1 << 10 * k)), F.lit(unit))).otherwise(out)
    return out


def binary_text(value: Column, width: int) -> Column:
    """An integer in binary digits."""
    return F.lpad(F.bin(value), width, "0")
