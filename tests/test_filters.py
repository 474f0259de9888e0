"""Filter expressions: what they let pass, frame by frame, and where wrong ones are wrong."""

import pytest

from capquill.operators import dissect as D
from capquill.operators import filters
from tests.test_stack import FRAMES, MACS, ip, tcp, udp


def passed(spark, frames, text):
    df = D.capture(spark.createDataFrame(list(enumerate(frames)), "num bigint, data binary"))
    return sorted(r.num for r in filters.matching(df, text).collect())


def test_frame_by_frame(spark):
    six = MACS + bytes.fromhex("86dd60000000000c1140") + bytes.fromhex("20010db8" + "00" * 11 + "01" + "fe80" + "00" * 13 + "09") + udp(53, 1000, b"abcd")
    frames = [
        MACS + b"\x08\x00" + ip(6, tcp(b"x")),  # 0: 10.0.0.1:1234 > 10.0.0.2:80
        MACS + b"\x08\x00" + ip(17, udp(9, 53, b"")),  # 1
        six,  # 2
        MACS + b"\x08\x06" + bytes.fromhex("000108000604000102000000000a" + "0a000005" + "000000000000" + "0a000001"),  # 3
        MACS + bytes.fromhex("8100000a0800") + ip(6, tcp(), src="c0a80101"),  # 4: tag 10
        FRAMES["Ether Dot1Q Dot1Q Dot1Q IP TCP"],  # 5: tags 1, 2, 3
        FRAMES["Ether MPLS MPLS MPLS Ether IP UDP Raw"],  # 6
        b"",  # 7
        MACS + b"\x08\x00" + ip(1, b"\x08\x00\x00\x00" + bytes(4)),  # 8
    ]
    cases = {
        "": list(range(9)),
        "ip": [0, 1, 8],
        "tcp": [0],
        "vlan": [4, 5],
        "vlan 10 and host 192.168.1.1": [4],
        "vlan and vlan 2 and vlan 3 and tcp port 80": [5],
        "mpls 1 and mpls 2": [6],
        "host 10.0.0.1": [0, 1, 3, 8],
        "arp src host 10.0.0.5 or arp dst 10.0.0.9": [3],
        "src or dst net 10": [0, 1, 3, 8],
        "src and dst net 10.0.0.0 mask 255.255.255.252": [0, 1, 8],
        "ip host 10.0.0.2 and not tcp": [1, 8],
        "udp port domain": [1, 2],
        "port 53 or 80 and src 10.0.0.1": [0, 1],
        "port 53 or (80 and src 10.0.0.1)": [0, 1, 2],
        "ip6 and src net 2001:db8::/33": [2],
        "dst net fe80::/10": [2],
        "host fe80::9": [2],
        "ip6 proto udp or ip proto \\icmp": [2, 8],
        "ip6 multicast or ip multicast or ether multicast": [0, 1, 2, 3, 4, 5, 6, 8],
        "ether broadcast and less 42": [1, 3, 8],
        "icmp[0] = 8 or icmp6[0] = 8": [8],
        "!ip[100] = 1 and ip": [0, 1, 8],
        "ip[0] >> 4 = 4 and ip[9] / 0 = 0": [],
        "5 - 6 > 4294967295 or 1 > 2": [],
        "5 - 6 = 0xffffffff and udp": [1, 2],
        "udp[2:2] * 0x10000000 * 16 = 0 and ip": [1],
        "not not not tcp and ip": [1, 8],
        "ether host 02:00:00:00:00:01 and arp": [3],
        "ether dst ff-ff-ff-ff-ff-ff and rarp": [],
    }
    for text, want in cases.items():
        assert passed(spark, frames, text) == want, text


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("tcp port", 8), ("tcp port 80 and", 15), ("port 99999", 5), ("(tcp", 4), ("tcp)", 3), ("host nowhere", 5), ("host 10.0.0.256", 5), ("net 10.0.0.1/8", 4),
        ("net 10.0.0.0/33", 13), ("net 10.0.0.0 mask 255.0.255.0", 18), ("ip[0:3] = 1", 5), ("icmp port 7", 11), ("ip6 host 10.0.0.1", 9), ("tcp # udp", 4), ("80", 0),
        ("portrange 1", 11), ("less x", 5), ("ether proto foo", 12), ("len >", 5), ("ether host 10.0.0.1", 11), ("tcp udp", 4),
    ],
)
def test_errors_have_a_position(spark, text, at):
    with pytest.raises(filters.FilterError) as e:
        filters.compiled(text)
    assert e.value.at == at, str(e.value)
