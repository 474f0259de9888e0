"""Capture filter expressions (`tcp port 80 and not host 10.0.0.1`) as one Column over a dissected capture.

The language is that of the pcap-filter manual. A primitive is a qualifier or several (protocol, direction, kind) and an id;
an id alone takes the qualifiers of the primitive before it, so that `port 80 or 443` reads as one would say it.
`not` binds first, `and` and `or` bind alike, from left to right. Comparisons are over unsigned 32-bit numbers, with
octets of headers (`ip[6:2] & 0x1fff != 0`, `tcp[tcpflags] & tcp-syn != 0`) and `len`. After `vlan` or `mpls`, what
follows is about packets within the tag, and before it about packets without one, as there.

Differences: what no header has is false, also where the octets are beyond the packet (there the whole filter then fails);
transport layers are those that dissection finds first, in IPv4 or IPv6; names of hosts and networks aren't resolved.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capquill.functions import octets as O
from capquill.operators.dissect import dissect
from capquill.operators.layers import LAYERS, SERVICES
from capquill.operators.layers import field as field_of

#: Keywords, with the layers that they mean, and named numbers and offsets of the language.
LAYER_OF = {
    "ether": "Ether", "ip": "IP", "ip6": "IPv6", "arp": "ARP", "tcp": "TCP", "udp": "UDP", "sctp": "SCTP", "icmp": "ICMP", "icmp6": "ICMPv6", "igmp": "IGMP",
    "vrrp": "VRRP", "ah": "AH", "esp": "ESP", "stp": "STP",
}
ETHER_PROTOCOLS = {"ip": 0x0800, "ip6": 0x86DD, "arp": 0x0806, "rarp": 0x8035, "pppoed": 0x8863, "pppoes": 0x8864, "loopback": 0x9000, "lldp": 0x88CC}
IP_PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "esp": 50, "ah": 51, "icmp6": 58, "pim": 103, "vrrp": 112, "sctp": 132, "igrp": 9}
NUMBERS = {
    "icmptype": 0, "icmpcode": 1, "icmp6type": 0, "icmp6code": 1, "tcpflags": 13,
    "icmp-echoreply": 0, "icmp-unreach": 3, "icmp-sourcequench": 4, "icmp-redirect": 5, "icmp-echo": 8, "icmp-routeradvert": 9, "icmp-routersolicit": 10,
    "icmp-timxceed": 11, "icmp-paramprob": 12, "icmp-tstamp": 13, "icmp-tstampreply": 14, "icmp-ireq": 15, "icmp-ireqreply": 16, "icmp-maskreq": 17, "icmp-maskreply": 18,
    "icmp6-destinationrunreach": 1, "icmp6-packettoobig": 2, "icmp6-timeexceeded": 3, "icmp6-parameterproblem": 4, "icmp6-echo": 128, "icmp6-echoreply": 129,
    "icmp6-routersolicit": 133, "icmp6-routeradvert": 134, "icmp6-neighborsolicit": 135, "icmp6-neighboradvert": 136, "icmp6-redirect": 137,
    "tcp-fin": 1, "tcp-syn": 2, "tcp-rst": 4, "tcp-push": 8, "tcp-ack": 16, "tcp-urg": 32, "tcp-ece": 64, "tcp-cwr": 128,
}
PORTED = ("TCP", "UDP", "SCTP")
SERVICE_PORTS = {name: number for number, name in SERVICES.items()}
DIRECTIONS, KINDS = ("src", "dst"), ("host", "net", "port", "portrange", "proto")
COMPARISONS = ("<=", ">=", "!=", "==", "<", ">", "=")
WORD32 = (1 << 32) - 1

_TOKEN = re.compile(
    r"""\s*(?:(?P<mac>(?:[0-9A-Fa-f]{1,2}[:-]){5}[0-9A-Fa-f]{1,2}(?![\w:]))
    |(?P<six>(?=[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:)[0-9A-Fa-f:]+(?:\.\d+){0,3})
    |(?P<dotted>\d+(?:\.\d+){1,3}(?![\w.]))
    |(?P<number>0[xX][0-9A-Fa-f]+|\d+)(?![A-Za-z_])
    |(?P<word>\\?[A-Za-z]\w*(?:-[A-Za-z]\w*)*)
    |(?P<sign>&&|\|\||<<|>>|<=|>=|!=|==|[()\[\]:!<>=&|^+\-*/%]))""",
    re.VERBOSE,
)


class FilterError(ValueError):
    """What is wrong with an expression, and at which character."""

    def __init__(self, text: str, at: int, why: str):
        super().__init__(f"{why} at character {at}: {text[:at]}>>>{text[at:]}")
        self.at = at


@dataclass(frozen=True)
class _Token:
    kind: str
    text: str
    at: int


def _tokens(text: str) -> list[_Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m or m.end() == m.start():
            at += len(text[at:]) - len(text[at:].lstrip())
            raise FilterError(text, at, "unknown sign")
        out.append(_Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return [*out, _Token("end", "", len(text))]


@dataclass
class Filter:
    """A filter as a Column, and the fields that `dissect` decodes for it."""

    column: Column
    fields: list[str]


@dataclass
class _Qualifiers:
    proto: str | None = None
    direction: str | None = None
    kind: str | None = None


@dataclass
class _Compiler:
    text: str
    tokens: list[_Token]
    k: int = 0
    #: Qualifiers of the last primitive, for an id that has none.
    last: _Qualifiers | None = None
    #: Tags and labels that the packets looked at have.
    tags: int = 0
    labels: int = 0
    fields: dict[str, None] = field(default_factory=dict)

    # Reading
    @property
    def now(self) -> _Token:
        return self.tokens[self.k]

    def fail(self, why: str, at: int | None = None) -> FilterError:
        return FilterError(self.text, self.now.at if at is None else at, why)

    def take(self, *texts: str) -> str | None:
        """The next token if it is one of these."""
        if self.now.kind in ("word", "sign") and self.now.text in texts:
            self.k += 1
            return self.tokens[self.k - 1].text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.fail(f"{text} expected")

    # Fields
    def raw(self, spec: str) -> Column:
        self.fields[spec] = None
        layer, name = field_of(spec)
        return layer.raw(name, decoded=layer.fields[name].numeric)

    def here(self, layer: str) -> Column:
        """The layer is there, at the depth of tags and labels that is looked at."""
        found = F.col(f"off_{layer}").isNotNull()
        if layer == "Ether":
            return found
        lowest = {"IP": "off_IP", "IPv6": "off_IPv6", "ARP": "off_ARP"}.get(layer)
        place = F.coalesce("off_IP", "off_IPv6", "off_ARP") if lowest is None else F.col(lowest)
        plain = place == 14 + 4 * (self.tags + self.labels)
        return found & F.when(F.col("off_Ether").isNotNull(), plain).otherwise(self.tags + self.labels == 0)

    def test(self, layer: str, condition: Column) -> Column:
        return F.coalesce(self.here(layer) & condition, F.lit(False))

    # Grammar
    def expression(self, depth: int = 0) -> Column:
        if depth > 200:
            raise self.fail("too many parentheses")
        left = self.negation(depth)
        while word := self.take("and", "or", "&&", "||"):
            right = self.negation(depth)
            left = left & right if word in ("and", "&&") else left | right
        return left

    def negation(self, depth: int) -> Column:
        times = 0
        while self.take("not", "!"):
            times += 1
        found = self.operand(depth)
        return ~found if times % 2 else found

    def operand(self, depth: int) -> Column:
        if self.is_comparison():
            return self.comparison()
        if self.take("("):
            found = self.expression(depth + 1)
            self.need(")")
            return found
        return self.primitive()

    def is_comparison(self) -> bool:
        """Whether a comparison sign comes before what would end a comparison."""
        depth = 0
        for t in self.tokens[self.k :]:
            if t.text in "([" and t.kind == "sign":
                depth += 1
            elif t.text in (")", "]") and t.kind == "sign":
                depth -= 1
                if depth < 0:
                    return False
            elif t.kind == "end" or t.text in ("and", "or", "not", "&&", "||", "!"):
                return False
            elif t.kind == "sign" and t.text in COMPARISONS and depth == 0:
                return True
        return False

    def comparison(self) -> Column:
        needed: list[Column] = []
        left = self.arithmetic(needed)
        sign = self.take(*COMPARISONS)
        if not sign:
            raise self.fail("comparison expected")
        right = self.arithmetic(needed)
        held = {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right, "!=": left != right}.get(sign, left == right)
        for condition in needed:
            held = condition & held
        return F.coalesce(held, F.lit(False))

    def arithmetic(self, needed: list[Column], level: int = 0) -> Column:
        signs = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
        if level == len(signs):
            return self.number(needed)
        left = self.arithmetic(needed, level + 1)
        while sign := self.take(*signs[level]):
            right = self.arithmetic(needed, level + 1)
            divisor = F.when(right != 0, right)
            places = F.least(right, F.lit(32)).cast("int")
            left = {
                "|": lambda a=left, b=right: a.bitwiseOR(b),
                "^": lambda a=left, b=right: a.bitwiseXOR(b),
                "&": lambda a=left, b=right: a.bitwiseAND(b),
                "<<": lambda a=left, p=places: F.call_function("shiftleft", a, p),
                ">>": lambda a=left, p=places: F.call_function("shiftright", a, p),
                "+": lambda a=left, b=right: a + b,
                "-": lambda a=left, b=right: a - b,
                "*": lambda a=left, b=right: (a.cast("decimal(20)") * b.cast("decimal(20)") % (1 << 32)).cast("bigint"),
                "/": lambda a=left, d=divisor: F.floor(a / d),
                "%": lambda a=left, d=divisor: a % d,
            }[sign]().bitwiseAND(WORD32)
        return left

    def number(self, needed: list[Column]) -> Column:
        t = self.now
        if self.take("("):
            inner = self.arithmetic(needed)
            self.need(")")
            return inner
        if self.take("-"):
            return (-self.number(needed)).bitwiseAND(WORD32)
        self.k += 1
        if t.kind == "number":
            return F.lit(int(t.text, 0) & WORD32).cast("bigint")
        if t.text == "len":
            return F.col("wirelen").cast("bigint")
        if t.text in NUMBERS:
            return F.lit(NUMBERS[t.text]).cast("bigint")
        if t.text in LAYER_OF and self.take("["):
            layer, size = LAYER_OF[t.text], 1
            at = self.arithmetic(needed)
            if self.take(":"):
                size, self.k = self.now, self.k + 1
                if size.text not in ("1", "2", "4"):
                    raise self.fail("1, 2 or 4 octets can be compared", size.at)
                size = int(size.text)
            self.need("]")
            place = F.col(f"off_{layer}") + at
            within = place + size <= F.length("data")
            needed.append(self.here(layer) & within)
            return O.be(F.col("data"), F.when(within, place).cast("int"), size)
        raise self.fail("number expected", t.at)

    def primitive(self) -> Column:
        t = self.now
        if t.kind == "word" and (special := getattr(self, f"word_{t.text}", None)):
            self.k += 1
            return special()
        q = _Qualifiers()
        if t.kind == "word" and t.text in (*LAYER_OF, "rarp"):
            self.k += 1
            q.proto = t.text
        if direction := self.take(*DIRECTIONS):
            q.direction = direction
            if self.now.text in ("or", "and") and self.tokens[self.k + 1].text in DIRECTIONS and self.tokens[self.k + 1].text != direction:
                q.direction = f"src {self.now.text} dst"
                self.k += 2
        if kind := self.take(*KINDS):
            q.kind = kind
        if q.proto and not q.direction and not q.kind:
            if q.proto == "ether" and (cast := self.take("broadcast", "multicast")):
                return self.word_broadcast() if cast == "broadcast" else self.word_multicast()
            if q.proto in ("ip", "ip6") and self.take("multicast"):
                return self.group_address(q.proto)
            if self.now.kind not in ("dotted", "six", "mac"):
                return self.protocol(q.proto)
        if q == _Qualifiers():
            if self.last is None:
                raise self.fail("primitive expected")
            if t.kind == "word" and t.text not in SERVICE_PORTS and t.text not in ("localhost",):
                raise self.fail("unknown word")
            q = self.last
        elif q.kind is None:
            q.kind = "host"
        self.last = q
        return self.by_kind(q)

    def by_kind(self, q: _Qualifiers) -> Column:
        return {"host": self.host, "net": self.net, "port": self.port, "portrange": self.portrange, "proto": self.proto_number}[q.kind](q)

    # Primitives
    def protocol(self, word: str) -> Column:
        if word == "rarp":
            return self.ether_type(ETHER_PROTOCOLS["rarp"])
        return self.here(LAYER_OF[word])

    def ether_type(self, number: int) -> Column:
        return F.coalesce(O.be(F.col("data"), F.col("off_Ether") + 12 + 4 * (self.tags + self.labels), 2) == number, F.lit(False))

    def ends(self, q: _Qualifiers, of) -> Column:
        """A condition on the source, the destination, either or both."""
        if q.direction in DIRECTIONS:
            return of(q.direction)
        return of("src") & of("dst") if q.direction == "src and dst" else of("src") | of("dst")

    def address(self) -> _Token:
        t = self.now
        if t.kind not in ("dotted", "six", "mac", "number"):
            raise self.fail("address expected: names aren't resolved" if t.kind == "word" else "address expected")
        self.k += 1
        return t

    def host(self, q: _Qualifiers) -> Column:
        t = self.address()
        if t.kind == "mac" or q.proto == "ether":
            if t.kind != "mac" or q.proto not in (None, "ether"):
                raise self.fail("Ethernet address expected" if q.proto == "ether" else "no Ethernet address here", t.at)
            octets = bytes(int(x, 16) for x in re.split("[:-]", t.text))
            return self.ends(q, lambda end: F.coalesce(self.raw(f"Ether.{end}") == F.lit(octets), F.lit(False)))
        return self.in_network(q, t, self.network(t, 128 if t.kind == "six" else 32))

    def network(self, t: _Token, length: int) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
        try:
            if t.kind == "six":
                return ipaddress.IPv6Network((t.text, length), strict=True)
            parts = [int(x) for x in t.text.split(".")]
            if max(parts) > 255:
                raise ValueError("part of an address over 255")
            number = sum(p << (24 - 8 * i) for i, p in enumerate(parts))
            return ipaddress.IPv4Network((number, length), strict=True)
        except ValueError as e:
            raise self.fail(str(e), t.at) from e

    def in_network(self, q: _Qualifiers, t: _Token, network) -> Column:
        six = network.version == 6
        if q.proto not in (None, "ip6") if six else q.proto not in (None, "ip", "arp", "rarp", "tcp", "udp", "sctp", "icmp", "igmp"):
            raise self.fail(f"no such address in {q.proto}", t.at)
        if six:
            whole, rest = divmod(network.prefixlen, 8)
            octets = network.network_address.packed

            def inside(end: str) -> Column:
                a = self.raw(f"IPv6.{end}")
                held = O.part(a, 0, whole) == F.lit(octets[:whole]) if whole else F.lit(True)
                if rest:
                    held = held & (F.shiftright(O.be(a, F.lit(whole), 1), 8 - rest) == octets[whole] >> (8 - rest))
                return self.test("IPv6", held)

            return self.ends(q, inside)
        number, shift = int(network.network_address), 32 - network.prefixlen

        def within(spec: str) -> Column:
            return F.shiftright(self.raw(spec), shift) == number >> shift

        out = F.lit(False)
        if q.proto != "arp":
            ip = self.ends(q, lambda end: self.test("IP", within(f"IP.{end}")))
            out = ip if q.proto in (None, "ip") else ip & self.here(LAYER_OF[q.proto])
        if q.proto in (None, "arp"):
            out = out | self.ends(q, lambda end: self.test("ARP", within(f"ARP.p{end}")))
        return out

    def net(self, q: _Qualifiers) -> Column:
        t = self.address()
        parts = t.text.count(".") + 1
        length = 128 if t.kind == "six" else 8 * parts
        if self.take("/"):
            size = self.now
            length = int(size.text) if size.kind == "number" and size.text.isdigit() else -1
            if not 0 <= length <= (128 if t.kind == "six" else 32):
                raise self.fail("length of a prefix expected")
            self.k += 1
        elif self.take("mask"):
            mask = self.address()
            number = int(self.network(mask, 32).network_address)
            length = number.bit_count()
            if number != (WORD32 << (32 - length)) & WORD32:
                raise self.fail("mask with gaps", mask.at)
        return self.in_network(q, t, self.network(t, length))

    def port_number(self) -> int:
        t = self.now
        number = int(t.text, 0) if t.kind == "number" else SERVICE_PORTS.get(t.text, -1)
        if not 0 <= number <= 65535:
            raise self.fail("port expected")
        self.k += 1
        return number

    def ported(self, q: _Qualifiers, low: int, high: int) -> Column:
        if q.proto is not None and LAYER_OF.get(q.proto) not in PORTED:
            raise self.fail(f"{q.proto} has no ports")
        out = F.lit(False)
        for layer in PORTED if q.proto is None else [LAYER_OF[q.proto]]:
            def of(end: str, layer: str = layer) -> Column:
                number = self.raw(f"{layer}.{end[0]}port")
                return self.test(layer, number.between(low, high) if low < high else number == low)

            out = out | self.ends(q, of)
        return out

    def port(self, q: _Qualifiers) -> Column:
        number = self.port_number()
        return self.ported(q, number, number)

    def portrange(self, q: _Qualifiers) -> Column:
        low = self.port_number()
        self.need("-")
        high = self.port_number()
        return self.ported(q, min(low, high), max(low, high))

    def proto_number(self, q: _Qualifiers) -> Column:
        self.take("!")
        t, self.k = self.now, self.k + 1
        named = ETHER_PROTOCOLS if q.proto == "ether" else IP_PROTOCOLS
        number = int(t.text, 0) if t.kind == "number" else named.get(t.text.lstrip("\\"), -1)
        if number < 0:
            raise self.fail("protocol expected", t.at)
        if q.proto == "ether":
            return self.ether_type(number)
        four, six = self.test("IP", self.raw("IP.proto") == number), self.test("IPv6", self.raw("IPv6.nh") == number)
        return {"ip": four, "ip6": six}.get(q.proto, four | six)

    def word_less(self) -> Column:
        return F.col("wirelen") <= self.size()

    def word_greater(self) -> Column:
        return F.col("wirelen") >= self.size()

    def size(self) -> int:
        if self.now.kind != "number":
            raise self.fail("number of octets expected")
        self.k += 1
        return int(self.tokens[self.k - 1].text, 0)

    def word_broadcast(self) -> Column:
        return F.coalesce(self.raw("Ether.dst") == F.lit(b"\xff" * 6), F.lit(False))

    def word_multicast(self) -> Column:
        return F.coalesce(O.be(F.col("data"), F.col("off_Ether"), 1).bitwiseAND(1) != 0, F.lit(False))

    def group_address(self, word: str) -> Column:
        layer, place, least, shift = ("IP", 16, 14, 4) if word == "ip" else ("IPv6", 24, 255, 0)
        return self.test(layer, F.shiftright(O.be(F.col("data"), F.col(f"off_{layer}") + place, 1), shift) == least)

    def word_vlan(self) -> Column:
        number = self.size() if self.now.kind == "number" else None
        self.tags += 1
        spec = f"Dot1Q:{self.tags}.vlan" if self.tags > 1 else "Dot1Q.vlan"
        found = self.raw(spec)
        return F.coalesce(found.isNotNull() if number is None else found == number, F.lit(False))

    def word_mpls(self) -> Column:
        number = self.size() if self.now.kind == "number" else None
        self.labels += 1
        spec = f"MPLS:{self.labels}.label" if self.labels > 1 else "MPLS.label"
        found = self.raw(spec)
        return F.coalesce(found.isNotNull() if number is None else found == number, F.lit(False))


def compiled(text: str) -> Filter:
    """A filter expression as a Column over a capture that was dissected with its fields; an empty one lets all pass."""
    c = _Compiler(text, _tokens(text))
    if c.now.kind == "end":
        return Filter(F.lit(True), [])
    column = c.expression()
    if c.now.kind != "end":
        raise c.fail("and, or or the end expected")
    return Filter(column, list(c.fields))


def matching(df: DataFrame, text: str) -> DataFrame:
    """The packets of a capture that a filter expression lets pass, by the columns of the capture."""
    f = compiled(text)
    layers = [*LAYER_OF.values(), "Dot1Q", "MPLS"]
    anchors = [*(f"off_{n}" for n in dict.fromkeys(layers)), *(field_of(s)[0].anchor for s in f.fields)]
    d = dissect(df, fields=f.fields, slim=[a for a in anchors if a.removeprefix("off_") in LAYERS or a[-1].isdigit()])
    return d.where(f.column).select(*[F.col(f"`{c}`") for c in df.columns])
