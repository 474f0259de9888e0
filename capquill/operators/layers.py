"""Layer specifications, written from the RFCs: where each field stands and how it reads."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.functions import octets as O


@dataclass(frozen=True)
class Field:
    """bit, width: position in the header. kind: uint, le, mac, ipv4, ipv6, flags or bytes."""

    bit: int
    width: int
    kind: str = "uint"
    #: Names of the bits of a flags field, the least significant first, and what stands between them.
    letters: tuple[str, ...] = ()
    between: str = ""
    names: dict[int, str] = field(default_factory=dict, hash=False)
    #: Another field and the values of it for which this one exists; else it is null.
    when: tuple[str, tuple[int, ...]] | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("uint", "ipv4", "flags")


@dataclass(frozen=True)
class Layer:
    name: str
    least: int
    fields: dict[str, Field] = field(hash=False)

    #: Which occurrence of the layer in a frame, from 1.
    nth: int = 1

    @property
    def anchor(self) -> str:
        """Column with the offset of the occurrence, null where the layer is absent."""
        return f"off_{self.name}" if self.nth == 1 else f"off_{self.name}_{self.nth}"

    def raw(self, name: str, decoded: bool = False) -> Column:
        """The field as an integer or octets; null where the layer is absent or the field inactive. decoded: from the column that `dissect` made."""
        f, at, data = self.fields[name], F.col(self.anchor), F.col("data")
        if decoded and f.numeric:
            return F.col(decoded_name(self, name))
        if f.kind in ("mac", "ipv6", "bytes"):
            value = O.part(data, at + f.bit // 8, f.width // 8)
        elif f.kind == "le":
            value = O.number(F.reverse(O.part(data, at + f.bit // 8, f.width // 8)))
        else:
            value = O.bits(data, at, f.bit, f.width)
        here = at.isNotNull()
        if f.when:
            here = here & self.raw(f.when[0]).isin(*f.when[1])
        return F.when(here, value)

    def value(self, name: str, decoded: bool = False) -> Column:
        """The field as users see it: addresses and flags as text, integers as they are."""
        f, raw = self.fields[name], self.raw(name, decoded)
        if f.kind == "ipv4":
            return F.when(raw.isNotNull(), O.ipv4_text(raw))
        if f.kind == "mac":
            return O.mac_text(raw)
        if f.kind == "ipv6":
            return O.ipv6_text(raw)
        if f.kind == "flags":
            return F.when(raw.isNotNull(), flag_letters(raw, f.letters, f.between))
        return raw

    def rendered(self, name: str, decoded: bool = False) -> Column:
        """Enumerated integers by their names, everything else as text."""
        value = self.value(name, decoded)
        out = value.cast("string") if self.fields[name].kind != "bytes" else F.lower(F.hex(value))
        for number, label in self.fields[name].names.items():
            out = F.when(value == number, label).otherwise(out)
        return out


def decoded_name(layer: Layer, name: str) -> str:
    return f"_field_{layer.name}_{layer.nth}_{name}"


def flag_letters(value: Column, letters: tuple[str, ...], between: str = "") -> Column:
    """The names of the set bits, the least significant first."""
    return F.concat_ws(between, *[F.when(value.bitwiseAND(1 << i) != 0, c) for i, c in enumerate(letters)])


def has_flag(spec: str, letter: str) -> Column:
    """Whether a packet has the layer and the flag of the name is set in the field."""
    layer, name = field(spec)
    return F.coalesce(layer.raw(name).bitwiseAND(1 << layer.fields[name].letters.index(letter)) != 0, F.lit(False))


def _row(spec: str, **more: dict) -> dict[str, Field]:
    """Fields in a row from "name:bits[:kind]" items."""
    out, bit = {}, 0
    for item in spec.split():
        name, width, kind = [*item.split(":"), "uint"][:3]
        out[name] = Field(bit, int(width), kind, **more.get(name, {}))
        bit += int(width)
    return out


#: Numbers and names assigned by IANA, and flag letters.
ETHER_TYPES = {0x0800: "IPv4", 0x0806: "ARP", 0x8100: "VLAN", 0x86DD: "IPv6"}
PROTOCOLS = {1: "icmp", 2: "igmp", 4: "ipencap", 6: "tcp", 17: "udp", 41: "ipv6", 47: "gre", 50: "esp", 58: "ipv6_icmp", 89: "ospf", 132: "sctp"}
ICMP_TYPES = {0: "echo-reply", 3: "dest-unreach", 4: "source-quench", 5: "redirect", 8: "echo-request", 11: "time-exceeded", 12: "parameter-problem"}
ARP_OPERATIONS = {1: "who-has", 2: "is-at"}
TCP_FLAGS = ("F", "S", "R", "P", "A", "U", "E", "C", "N")
IP_FLAGS = ("MF", "DF", "evil")
ICMPV6_TYPES = {1: "dest-unreach", 2: "packet-too-big", 3: "time-exceeded", 4: "parameter-problem", 128: "echo-request", 129: "echo-reply", 133: "router-solicit", 134: "router-advert", 135: "neighbor-solicit", 136: "neighbor-advert"}
IGMP_TYPES = {17: "query", 18: "report-v1", 22: "report-v2", 23: "leave", 34: "report-v3"}
PPP_CODES = {1: "Configure-Request", 2: "Configure-Ack", 3: "Configure-Nak", 4: "Configure-Reject", 5: "Terminate-Request", 6: "Terminate-Ack", 7: "Code-Reject", 8: "Protocol-Reject", 9: "Echo-Request", 10: "Echo-Reply", 11: "Discard-Request"}
RADIUS_CODES = {1: "Access-Request", 2: "Access-Accept", 3: "Access-Reject", 4: "Accounting-Request", 5: "Accounting-Response", 11: "Access-Challenge"}
DHCP6_TYPES = {1: "SOLICIT", 2: "ADVERTISE", 3: "REQUEST", 4: "CONFIRM", 5: "RENEW", 6: "REBIND", 7: "REPLY", 8: "RELEASE", 9: "DECLINE", 10: "RECONFIGURE", 11: "INFORMATION-REQUEST"}
SERVICES = {20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain", 67: "bootps", 68: "bootpc", 80: "http", 110: "pop3", 123: "ntp", 143: "imap", 161: "snmp", 179: "bgp", 389: "ldap", 443: "https", 514: "syslog", 520: "router", 5060: "sip"}

_ECHO = {"when": ("type", (0, 8, 13, 14, 15, 16, 17, 18))}
LAYERS = {
    layer.name: layer
    for layer in (
        Layer("Ether", 14, _row("dst:48:mac src:48:mac type:16", type={"names": ETHER_TYPES})),
        Layer("Loopback", 4, _row("type:32:le")),
        Layer("CookedLinux", 16, _row("pkttype:16 lladdrtype:16 lladdrlen:16 src:64:bytes proto:16", proto={"names": ETHER_TYPES})),
        Layer("CookedLinuxV2", 20, _row("proto:16 reserved:16 ifindex:32 lladdrtype:16 pkttype:8 lladdrlen:8 src:64:bytes", proto={"names": ETHER_TYPES})),
        Layer("Dot1Q", 4, _row("prio:3 dei:1 vlan:12 type:16", type={"names": ETHER_TYPES})),
        Layer("ARP", 28, _row("hwtype:16 ptype:16 hwlen:8 plen:8 op:16 hwsrc:48:mac psrc:32:ipv4 hwdst:48:mac pdst:32:ipv4", ptype={"names": ETHER_TYPES}, op={"names": ARP_OPERATIONS})),
        Layer("IP", 20, _row("version:4 ihl:4 tos:8 len:16 id:16 flags:3:flags frag:13 ttl:8 proto:8 chksum:16 src:32:ipv4 dst:32:ipv4", flags={"letters": IP_FLAGS, "between": "+"}, proto={"names": PROTOCOLS})),
        Layer("IPv6", 40, _row("version:4 tc:8 fl:20 plen:16 nh:8 hlim:8 src:128:ipv6 dst:128:ipv6", nh={"names": PROTOCOLS})),
        Layer("TCP", 20, _row("sport:16 dport:16 seq:32 ack:32 dataofs:4 reserved:3 flags:9:flags window:16 chksum:16 urgptr:16", flags={"letters": TCP_FLAGS})),
        Layer("UDP", 8, _row("sport:16 dport:16 len:16 chksum:16")),
        Layer("ICMP", 8, _row("type:8 code:8 chksum:16 id:16 seq:16", type={"names": ICMP_TYPES}, id=_ECHO, seq=_ECHO)),
        Layer("ICMPv6", 4, _row("type:8 code:8 chksum:16", type={"names": ICMPV6_TYPES})),
        Layer("IGMP", 8, _row("type:8 mrcode:8 chksum:16 gaddr:32:ipv4", type={"names": IGMP_TYPES})),
        Layer("OSPF", 24, _row("version:8 type:8 len:16 src:32:ipv4 area:32:ipv4 chksum:16 authtype:16")),
        Layer("GRE", 4, _row("chksum_present:1 routing_present:1 key_present:1 seqnum_present:1 strict:1 recursion:3 flags:5 version:3 proto:16", proto={"names": ETHER_TYPES})),
        Layer("VXLAN", 8, _row("flags:8 gpid:16 reserved1:8 vni:24 reserved2:8")),
        Layer("DNS", 12, _row("id:16 qr:1 opcode:4 aa:1 tc:1 rd:1 ra:1 z:1 ad:1 cd:1 rcode:4 qdcount:16 ancount:16 nscount:16 arcount:16")),
        Layer("NTP", 48, _row("leap:2 version:3 mode:3 stratum:8 poll:8 precision:8")),
        Layer("SCTP", 12, _row("sport:16 dport:16 tag:32 chksum:32")),
        Layer("RIP", 4, _row("cmd:8 version:8 null:16")),
        Layer("BOOTP", 236, _row("op:8 htype:8 hlen:8 hops:8 xid:32 secs:16 flags:16 ciaddr:32:ipv4 yiaddr:32:ipv4 siaddr:32:ipv4 giaddr:32:ipv4 chaddr:48:mac")),
        Layer("NetFlowV5", 24, _row("version:16 count:16 uptime:32 secs:32 nsecs:32 sequence:32 engine_type:8 engine_id:8 sampling:16")),
        Layer("Geneve", 8, _row("version:2 optlen:6 oam:1 critical:1 reserved:6 proto:16 vni:24 reserved2:8", proto={"names": ETHER_TYPES})),
        Layer("GTP_U", 8, _row("version:3 pt:1 reserved:1 e:1 s:1 pn:1 type:8 len:16 teid:32")),
        Layer("TLS", 5, _row("type:8 version:16 len:16", type={"names": {20: "change_cipher_spec", 21: "alert", 22: "handshake", 23: "application_data"}})),
        Layer("MPLS", 4, _row("label:20 cos:3 s:1 ttl:8")),
        Layer("PPPoE", 6, _row("version:4 type:4 code:8 sessionid:16 len:16")),
        Layer("LLC", 3, _row("dsap:8 ssap:8 ctrl:8")),
        Layer("IPv6ExtHdrHopByHop", 8, _row("nh:8 len:8", nh={"names": PROTOCOLS})),
        Layer("IPv6ExtHdrRouting", 8, _row("nh:8 len:8 type:8 segleft:8", nh={"names": PROTOCOLS})),
        Layer("IPv6ExtHdrFragment", 8, _row("nh:8 res1:8 offset:13 res2:2 m:1 id:32", nh={"names": PROTOCOLS})),
        Layer("IPv6ExtHdrDestOpt", 8, _row("nh:8 len:8", nh={"names": PROTOCOLS})),
        Layer("AH", 12, _row("nh:8 payloadlen:8 reserved:16 spi:32 seq:32", nh={"names": PROTOCOLS})),
        Layer("ESP", 8, _row("spi:32 seq:32")),
        Layer("VRRP", 8, _row("version:4 type:4 vrid:8 priority:8 ipcount:8 authtype:8 adv:8 chksum:16")),
        Layer("ERSPAN_II", 8, _row("ver:4 vlan:12 cos:3 en:2 t:1 session_id:10 reserved:12 index:20")),
        Layer("ERSPAN_III", 12, _row("ver:4 vlan:12 cos:3 bso:2 t:1 session_id:10 timestamp:32 sgt:16 p:1 ft:5 hwid:6 d:1 gra:2 o:1")),
        Layer("PPP", 2, _row("proto:16")),
        Layer("PPP_LCP", 4, _row("code:8 id:8 len:16", code={"names": PPP_CODES})),
        Layer("PPP_IPCP", 4, _row("code:8 id:8 len:16", code={"names": PPP_CODES})),
        Layer("PPP_PAP", 4, _row("code:8 id:8 len:16")),
        Layer("PPP_CHAP", 4, _row("code:8 id:8 len:16")),
        Layer("LLDPDU", 2, _row("type:7 len:9")),
        Layer("EAPOL", 4, _row("version:8 type:8 len:16")),
        Layer("STP", 35, _row("proto:16 version:8 bpdutype:8 bpduflags:8 rootid:16 rootmac:48:mac pathcost:32 bridgeid:16 bridgemac:48:mac portid:16 age:16 maxage:16 hellotime:16 fwddelay:16")),
        Layer("Radius", 20, _row("code:8 id:8 len:16 authenticator:128:bytes", code={"names": RADIUS_CODES})),
        Layer("DHCP6", 4, _row("msgtype:8 trid:24", msgtype={"names": DHCP6_TYPES})),
        Layer("ISAKMP", 28, _row("init_cookie:64:bytes resp_cookie:64:bytes next_payload:8 version:8 exch_type:8 flags:8 id:32 length:32")),
        Layer("TFTP", 2, _row("op:16", op={"names": {1: "RRQ", 2: "WRQ", 3: "DATA", 4: "ACK", 5: "ERROR", 6: "OACK"}})),
        Layer("BFD", 24, _row("version:3 diag:5 sta:2 flags:6 detect_mult:8 len:8 my_discriminator:32 your_discriminator:32 min_tx_interval:32 min_rx_interval:32 echo_rx_interval:32")),
        Layer("HSRP", 20, _row("version:8 opcode:8 state:8 hellotime:8 holdtime:8 priority:8 group:8 reserved:8 auth:64:bytes virtualIP:32:ipv4")),
        Layer("BGPHeader", 19, _row("marker:128:bytes len:16 type:8", type={"names": {1: "OPEN", 2: "UPDATE", 3: "NOTIFICATION", 4: "KEEPALIVE"}})),
        Layer("SNAP", 5, _row("oui:24 code:16", code={"names": ETHER_TYPES})),
    )
}


#: Elements that repeat after a header.
RIP_ENTRY = Layer("RIPEntry", 20, _row("family:16 tag:16 addr:32:ipv4 mask:32:ipv4 nexthop:32:ipv4 metric:32"))
NETFLOW_RECORD = Layer("NetFlowRecordV5", 48, _row("src:32:ipv4 dst:32:ipv4 nexthop:32:ipv4 input:16 output:16 packets:32 octets:32 first:32 last:32 sport:16 dport:16 pad1:8 tcp_flags:8 proto:8 tos:8 src_as:16 dst_as:16 src_mask:8 dst_mask:8 pad2:16"))


def user_layer(name: str, fields: dict[str, Field]) -> Layer:
    """A declared layer; its widths must add up to whole octets. `dissect` places it with `bind`."""
    total = sum(f.width for f in fields.values())
    if total % 8 or not fields:
        raise ValueError(f"{name}: widths add up to {total} bits")
    return Layer(name, total // 8, fields)


def field(spec: str | tuple, layers: dict[str, Layer] | None = None) -> tuple[Layer, str]:
    """"Layer.field", or "Layer:3.field" of the third occurrence."""
    layer, name = spec.split(".") if isinstance(spec, str) else spec[:2]
    known = layers or LAYERS
    layer, _, nth = layer.partition(":")
    if layer not in known or name not in known[layer].fields or not (nth == "" or nth.isdigit() and 1 <= int(nth) <= 32):
        raise ValueError(f"no field {layer}.{name}")
    return replace(known[layer], nth=int(nth or 1)), name


def service(port: Column) -> Column:
    """Name of a well-known port, else its number."""
    out = port.cast("string")
    for number, label in SERVICES.items():
        out = F.when(port == number, label).otherwise(out)
    return out


def catalog(spark: SparkSession) -> DataFrame:
    """layer, field, bit, width, kind of all fields."""
    rows = [(x.name, n, f.bit, f.width, f.kind, f.names or None, list(f.letters) or None) for x in LAYERS.values() for n, f in x.fields.items()]
    return spark.createDataFrame(rows, "layer string, field string, bit int, width int, kind string, enum_names map<int,string>, flag_names array<string>")


def known_layers(spark: SparkSession) -> DataFrame:
    """layer, least (octets), fields (their number) of all layers."""
    return spark.createDataFrame([(x.name, x.least, len(x.fields)) for x in LAYERS.values()], "layer string, least int, fields int")
