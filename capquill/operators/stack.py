"""The stack of layers of each frame: a worklist over all frames of a batch at once.

Each step looks at one layer of every frame that is not done: frames are told apart by the layer they are at, and the rule
of that layer gives, for all of its frames together, which layer follows, where, and how far the packet reaches at most.
So a stack may have any form, tunnels within tunnels included, up to `STEPS` layers. A layer that has no room for its
shortest header is Raw, a length that is told only ever makes the end come sooner, and what no layer claims is Raw.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from capquill.operators.layers import LAYERS, Layer

STEPS = 32
NONE = -1

#: Numbers assigned by IANA and IEEE, by which a layer tells the next one.
ETHER_TYPES = {
    0x0800: "IP", 0x0806: "ARP", 0x86DD: "IPv6", 0x8100: "Dot1Q", 0x88A8: "Dot1Q", 0x8847: "MPLS", 0x8848: "MPLS", 0x8864: "PPPoE",
    0x880B: "PPP", 0x6558: "Ether", 0x88CC: "LLDPDU", 0x888E: "EAPOL",
}
PROTOCOLS = {1: "ICMP", 2: "IGMP", 4: "IP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 112: "VRRP", 132: "SCTP"}
EXTENSIONS = {0: "IPv6ExtHdrHopByHop", 43: "IPv6ExtHdrRouting", 44: "IPv6ExtHdrFragment", 60: "IPv6ExtHdrDestOpt"}
PPP_PROTOCOLS = {0x0021: "IP", 0x0057: "IPv6", 0x0281: "MPLS", 0x0283: "MPLS", 0xC021: "PPP_LCP", 0x8021: "PPP_IPCP", 0xC023: "PPP_PAP", 0xC223: "PPP_CHAP"}
#: Ports of UDP and TCP; of several that match a packet the first one in this order counts.
UDP_PORTS = {
    "DNS": (53,), "NTP": (123,), "VXLAN": (4789,), "RIP": (520,), "BOOTP": (67, 68), "NetFlowV5": (2055,), "Geneve": (6081,), "GTP_U": (2152,),
    "Radius": (1812, 1813, 1645, 1646), "DHCP6": (546, 547), "ISAKMP": (500,), "TFTP": (69,), "BFD": (3784, 3785, 4784), "HSRP": (1985,),
}
TCP_PORTS = {"BGPHeader": (179,)}
#: Link types of capture files, and address families of BSD loopback headers.
LINKS = {1: "Ether", 0: "Loopback", 108: "Loopback", 113: "CookedLinux", 276: "CookedLinuxV2", 9: "PPP"}
BARE_IP = (12, 14, 101, 228, 229)
FAMILIES = {2: "IP", 10: "IPv6", 24: "IPv6", 28: "IPv6", 30: "IPv6"}
ERSPAN, ERSPAN_3, PPTP, USER_DATA = 0x88BE, 0x22EB, 1, 255
#: Layers that begin a packet of their own: within another packet they are the inside of a tunnel.
PACKETS = ("IP", "IPv6", "ARP", "Ether")


class Batch:
    """Frames of a batch as one array of octets; offsets are arrays with -1 where a layer is absent."""

    def __init__(self, data: pa.Array, linktype: np.ndarray):
        data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
        data = data.cast(pa.large_binary()).fill_null(b"")
        _, offsets, raw = data.buffers()
        off = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
        self.raw = np.append(np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8), np.zeros(1, np.uint8))
        self.base, self.size, self.linktype = off[:-1], np.diff(off), linktype

    def be(self, at: np.ndarray, n: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Unsigned integers of n octets of the rows' frames; 0 where they aren't wholly there."""
        good = (at >= 0) & (at + n <= self.size[rows])
        where = np.where(good, self.base[rows] + at, max(0, len(self.raw) - n))
        value = np.zeros(len(at), np.int64)
        for i in range(n):
            value = value << 8 | self.raw[np.minimum(where + i, len(self.raw) - 1)]
        return np.where(good, value, 0)

    def bits(self, at: np.ndarray, bit: int, width: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        low, high = bit // 8, (bit + width - 1) // 8
        return self.be(np.where(at < 0, -1, at + low), high - low + 1, rows) >> (8 * (high + 1) - bit - width) & (1 << width) - 1


@dataclass(frozen=True)
class Bind:
    """A layer placed over the payload of a parent, before any of the rules here.

    when: numbers of the parent's fields; guard: numbers of the layer's own fields, so that one port may have several variants
    told apart by content. A value or several. Of bindings that match, the one of the highest priority counts, then the last.
    """

    layer: Layer
    parent: str
    when: dict[str, object] = field(default_factory=dict, hash=False)
    guard: dict[str, object] = field(default_factory=dict, hash=False)
    priority: int = 0


def binds_of(bind: Sequence[Bind | tuple]) -> list[Bind]:
    """Bindings in the order in which they are tried."""
    made = [b if isinstance(b, Bind) else Bind(*b) for b in bind]
    return sorted(reversed(made), key=lambda b: -b.priority)


class Names:
    """Layers by number: 0 is Raw."""

    def __init__(self, binds: Sequence[Bind]):
        own = {b.layer.name: b.layer for b in binds}
        self.layers = {**LAYERS, **own}
        self.names = ["Raw", *self.layers]
        self.number = {n: i for i, n in enumerate(self.names)}
        self.least = np.array([0, *(x.least for x in self.layers.values())], np.int64)
        #: Layers of applications take all that is left, and are payload to those below.
        self.application = np.isin(self.names, [*(n for n in (*UDP_PORTS, *TCP_PORTS, "TLS", *own) if n not in RULES)])

    def table(self, named: dict[int, str], size: int) -> np.ndarray:
        out = np.zeros(size, np.int16)
        for number, name in named.items():
            out[number] = self.number[name]
        return out

    def ranked(self, ports: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each port (0: no claim; the first claim has the highest), and the layer of each rank."""
        rank, of = np.zeros(65536, np.int16), np.zeros(len(ports) + 1, np.int16)
        for k, (name, numbers) in enumerate(reversed(ports.items()), 1):
            rank[list(numbers)], of[k] = k, self.number[name]
        return rank, of


@dataclass
class Found:
    """What a batch's frames hold: offsets by layer (first occurrence), of further occurrences that were asked for, and the chain."""

    first: dict[str, np.ndarray]
    further: dict[tuple[str, int], np.ndarray]
    chain_rows: np.ndarray
    chain_layers: np.ndarray
    after: np.ndarray
    stop: np.ndarray
    end: np.ndarray
    #: Rows, layers and offsets of each step.
    places: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class _Walk:
    def __init__(self, b: Batch, names: Names, binds: Sequence[Bind]):
        self.b, self.n, self.binds = b, names, binds
        self.end = b.size.astype(np.int64).copy()
        n = names
        self.ether, self.ppp = n.table(ETHER_TYPES, 65536), n.table(PPP_PROTOCOLS, 65536)
        self.proto, self.next6 = n.table(PROTOCOLS, 256), n.table({**PROTOCOLS, **EXTENSIONS}, 256)
        self.family = n.table(FAMILIES, 256)
        self.udp, self.tcp = n.ranked(UDP_PORTS), n.ranked(TCP_PORTS)
        self.rules: dict[int, Callable] = {}
        for name, rule in RULES.items():
            self.rules[n.number[name]] = rule

    def tighten(self, rows: np.ndarray, end: np.ndarray) -> None:
        self.end[rows] = np.minimum(self.end[rows], end)

    def version(self, rows: np.ndarray, at: np.ndarray, other: str = "Raw") -> np.ndarray:
        """IP or IPv6 by the first half octet."""
        nibble = np.where(at < self.end[rows], self.b.be(at, 1, rows) >> 4, 0)
        number = self.n.number
        return np.where(nibble == 4, number["IP"], np.where(nibble == 6, number["IPv6"], number[other]))

    def start(self) -> np.ndarray:
        link = np.full(len(self.b.size), 0, np.int64)
        for kind, name in LINKS.items():
            link[self.b.linktype == kind] = self.n.number[name]
        bare = np.flatnonzero(np.isin(self.b.linktype, BARE_IP))
        link[bare] = self.version(bare, np.zeros(len(bare), np.int64))
        return link

    def follow(self, layer: int, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which layer comes after one, and where."""
        rule = self.rules.get(layer)
        after, then = rule(self, rows, at) if rule else (0, at + self.n.least[layer])
        then = np.minimum(then, self.end[rows])
        after = np.broadcast_to(np.asarray(after), rows.shape)
        name = self.n.names[layer]
        free = np.ones(len(rows), bool)
        for bind in self.binds:
            if bind.parent == name:
                holds = free & (self.end[rows] - then >= bind.layer.least)
                for where, of, wanted in ((at, self.n.layers[name], bind.when), (then, bind.layer, bind.guard)):
                    for key, values in wanted.items():
                        f = of.fields[key]
                        values = values if isinstance(values, (list, tuple, set, range)) else [values]
                        holds &= np.isin(self.b.bits(where, f.bit, f.width, rows), list(values))
                after = np.where(holds, self.n.number[bind.layer.name], after)
                free &= ~holds
        if self.n.application[layer]:
            then = np.where(free, self.end[rows], then)
        return after, then


def walk(b: Batch, names: Names, binds: Sequence[Bind] = (), further: Sequence[tuple[str, int]] = ()) -> Found:
    w, count = _Walk(b, names, binds), len(b.size)
    first = np.full((len(names.names), count), NONE, np.int64)
    more = {x: np.full(count, NONE, np.int64) for x in further}
    seen = np.zeros((len(names.names), count), np.int16)
    is_packet = np.isin(np.arange(len(names.names)), [names.number[x] for x in PACKETS])
    of_network = is_packet & (np.arange(len(names.names)) != names.number["Ether"])
    rows, at, layer = np.arange(count), np.zeros(count, np.int64), w.start()
    after, outer = np.zeros(count, np.int64), np.full(count, NONE, np.int64)
    networked, within = np.zeros(count, bool), np.zeros(count, bool)
    places = []
    for step in range(STEPS):
        room = w.end[rows] - at
        layer = np.where(room < names.least[layer], 0, layer)
        layer = np.where((layer == 0) & (room <= 0), NONE, layer)
        layer = np.where((layer > 0) & (step == STEPS - 1), 0, layer)
        inside = is_packet[layer] & (layer > 0) & (networked[rows] | ((layer == names.number["Ether"]) & (step > 0))) & (outer[rows] == NONE)
        outer[rows[inside]] = w.end[rows[inside]]
        networked[rows] |= of_network[layer] & (layer > 0)
        here = layer >= 0
        held, where = rows[here], at[here]
        kind = layer[here]
        k = seen[kind, held]
        new = k == 0
        first[kind[new], held[new]] = where[new]
        for (name, nth), place in more.items():
            hit = (kind == names.number[name]) & (k == nth - 1)
            place[held[hit]] = where[hit]
        seen[kind, held] += 1
        places.append((held, kind, where))
        below = ~within[rows]
        after[rows[below]] = at[below]
        within[rows] |= names.application[layer] & (layer > 0)
        going = layer > 0
        rows, at, layer = rows[going], at[going], layer[going]
        if not len(rows):
            break
        then, place = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for kind in np.unique(layer):
            m = np.flatnonzero(layer == kind)
            then[m], place[m] = w.follow(int(kind), rows[m], at[m])
        layer, at = then, place
    all_rows = np.concatenate([p[0] for p in places])
    order = np.argsort(all_rows, kind="stable")
    end = np.where(outer == NONE, w.end, outer)
    by_name = {n: first[i] for i, n in enumerate(names.names)}
    return Found(by_name, more, all_rows[order], np.concatenate([p[1] for p in places])[order], after, w.end, end, places)


# Rules: for the rows of one layer at their offsets, the layer that follows and where
def _ether_type(w: _Walk, rows: np.ndarray, at: np.ndarray, place: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """By an EtherType, or by a length, which LLC follows."""
    kind, then = w.b.be(at + place, 2, rows), at + length
    sized = kind <= 1500
    w.tighten(rows[sized], (then + kind)[sized])
    return np.where(sized, w.n.number["LLC"], w.ether[kind]), then


def _ether(w, rows, at):
    return _ether_type(w, rows, at, 12, 14)


def _vlan(w, rows, at):
    return _ether_type(w, rows, at, 2, 4)


def _loopback(w, rows, at):
    # the family is in the order of the host that captured, and small: its octets are 0 but for the first or the last
    return w.family[w.b.be(at, 1, rows) | w.b.be(at + 3, 1, rows)], at + 4


def _cooked(w, rows, at):
    return w.ether[w.b.be(at + 14, 2, rows)], at + 16


def _cooked_v2(w, rows, at):
    return w.ether[w.b.be(at, 2, rows)], at + 20


def _llc(w, rows, at):
    snap, spanning = w.b.be(at, 3, rows) == 0xAAAA03, w.b.be(at, 2, rows) == 0x4242
    return np.where(snap, w.n.number["SNAP"], np.where(spanning, w.n.number["STP"], 0)), at + 3


def _snap(w, rows, at):
    return np.where(w.b.be(at, 3, rows) == 0, w.ether[w.b.be(at + 3, 2, rows)], 0), at + 5


def _arp(w, rows, at):
    w.tighten(rows, at + 28)
    return 0, at + 28


def _ip(w, rows, at):
    head = np.maximum(w.b.bits(at, 4, 4, rows) * 4, 20)
    w.tighten(rows, at + np.maximum(w.b.be(at + 2, 2, rows), head))
    later = w.b.bits(at, 51, 13, rows) != 0
    return np.where(later, 0, w.proto[w.b.be(at + 9, 1, rows)]), at + head


def _ip6(w, rows, at):
    w.tighten(rows, at + 40 + w.b.be(at + 4, 2, rows))
    return w.next6[w.b.be(at + 6, 1, rows)], at + 40


def _extension(w, rows, at):
    return w.next6[w.b.be(at, 1, rows)], at + 8 * (w.b.be(at + 1, 1, rows) + 1)


def _fragment(w, rows, at):
    later = w.b.bits(at, 16, 13, rows) != 0
    return np.where(later, 0, w.next6[w.b.be(at, 1, rows)]), at + 8


def _ah(w, rows, at):
    return w.next6[w.b.be(at, 1, rows)], at + 4 * (w.b.be(at + 1, 1, rows) + 2)


def _mpls(w, rows, at):
    bottom = w.b.bits(at, 23, 1, rows) == 1
    return np.where(bottom, w.version(rows, at + 4, "Ether"), w.n.number["MPLS"]), at + 4


def _pppoe(w, rows, at):
    w.tighten(rows, at + 6 + w.b.be(at + 4, 2, rows))
    return np.where(w.b.be(at + 1, 1, rows) == 0, w.n.number["PPP"], 0), at + 6


def _ppp(w, rows, at):
    # HDLC framing, where a link has it, stands before the protocol
    framed = 2 * (w.b.be(at, 2, rows) == 0xFF03)
    return w.ppp[w.b.be(at + framed, 2, rows)], at + 2 + framed


def _tcp(w, rows, at):
    then = np.minimum(at + np.maximum(w.b.bits(at, 96, 4, rows) * 4, 20), w.end[rows])
    room = w.end[rows] - then
    claim = _ports(w, w.tcp, rows, at, then)
    bgp = (claim == w.n.number["BGPHeader"]) & (w.b.be(then, 4, rows) != 0xFFFFFFFF)
    # no port but the content says that it is TLS: a record type, version 3.x and a length that may be
    kind, major, minor, told = (w.b.be(then + i, n, rows) for i, n in ((0, 1), (1, 1), (2, 1), (3, 2)))
    tls = (room >= 5) & (kind >= 20) & (kind <= 23) & (major == 3) & (minor <= 4) & (told <= 16384 + 2048)
    return np.where(tls, w.n.number["TLS"], np.where(bgp, 0, claim)), then


def _ports(w, claims, rows, at, then):
    rank, of = claims
    best = np.maximum(rank[w.b.be(at, 2, rows)], rank[w.b.be(at + 2, 2, rows)])
    return of[best]


def _udp(w, rows, at):
    told = w.b.be(at + 4, 2, rows)
    w.tighten(rows, np.where(told >= 8, at + told, w.end[rows]))
    claim = _ports(w, w.udp, rows, at, at + 8)
    other = (claim == w.n.number["NetFlowV5"]) & (w.b.be(at + 8, 2, rows) != 5)
    return np.where(other, 0, claim), at + 8


def _gre(w, rows, at):
    flags, proto = w.b.be(at, 2, rows), w.b.be(at + 2, 2, rows)
    bit = lambda mask: (flags & mask != 0).astype(np.int64)
    version, sequenced = flags & 7, bit(0x1000)
    size = 4 + 4 * (bit(0x8000) + bit(0x2000) + sequenced) + np.where(version == 1, 4 * bit(0x0080), 0)
    number = w.n.number
    kind = np.where(proto == ERSPAN, np.where(sequenced == 1, number["ERSPAN_II"], number["Ether"]), np.where(proto == ERSPAN_3, number["ERSPAN_III"], w.ether[proto]))
    routed = (flags & 0x4000 != 0) | (version > PPTP)  # source routes are of no fixed size
    return np.where(routed, 0, kind), at + np.where(routed, 4, size)


def _erspan3(w, rows, at):
    return w.n.number["Ether"], at + 12 + 8 * w.b.bits(at, 95, 1, rows)


def _vxlan(w, rows, at):
    return w.n.number["Ether"], at + 8


def _geneve(w, rows, at):
    return w.ether[w.b.be(at + 2, 2, rows)], at + 8 + 4 * w.b.bits(at, 2, 6, rows)


def _gtp(w, rows, at):
    flags = w.b.be(at, 1, rows)
    then = at + np.where(flags & 7, 12, 8)
    kind = np.where(flags & 4, w.b.be(at + 11, 1, rows), 0)
    for _ in range(8):  # extension headers: a length in units of four octets, and the next type at the end
        units = np.where(kind != 0, w.b.be(then, 1, rows), 0)
        then = then + 4 * units
        kind = np.where(units > 0, w.b.be(then - 1, 1, rows), kind)
    user = (w.b.be(at + 1, 1, rows) == USER_DATA) & (kind == 0)
    return np.where(user, w.version(rows, then), 0), then


RULES: dict[str, Callable] = {
    "Ether": _ether, "Dot1Q": _vlan, "Loopback": _loopback, "CookedLinux": _cooked, "CookedLinuxV2": _cooked_v2, "LLC": _llc, "SNAP": _snap, "ARP": _arp,
    "IP": _ip, "IPv6": _ip6, "IPv6ExtHdrHopByHop": _extension, "IPv6ExtHdrRouting": _extension, "IPv6ExtHdrDestOpt": _extension, "IPv6ExtHdrFragment": _fragment,
    "AH": _ah, "MPLS": _mpls, "PPPoE": _pppoe, "PPP": _ppp, "TCP": _tcp, "UDP": _udp, "GRE": _gre, "ERSPAN_II": _vxlan, "ERSPAN_III": _erspan3,
    "VXLAN": _vxlan, "Geneve": _geneve, "GTP_U": _gtp,
}
