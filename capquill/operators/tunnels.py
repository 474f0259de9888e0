"""Frames within tunnels, given out as captures of their own, so that everything else works on them as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capquill.functions import octets as O
from capquill.operators.dissect import dissect
from capquill.operators.layers import LAYERS

#: Link types of what is inside, the type of bridged Ethernet, PPP protocols of IP, GTP-U's type of user data.
ETHERNET, BARE_IP, BRIDGED, PPP_IP, USER_DATA = 1, 101, 0x6558, (0x0021, 0x0057), 255
_IP = (0x0800, 0x86DD)


def _gtp_start() -> Column:
    """Offset behind a GTP-U header with its optional octets and extension headers."""
    data, at = F.col("data"), F.col("off_GTP_U")
    any_of = LAYERS["GTP_U"].raw("e") + LAYERS["GTP_U"].raw("s") + LAYERS["GTP_U"].raw("pn")
    # each extension header tells its length in units of four octets and ends in the type of the next one
    start = F.struct((at + 12).alias("at"), F.when(LAYERS["GTP_U"].raw("e") == 1, O.be(data, at + 11, 1)).otherwise(F.lit(0)).cast("bigint").alias("next"))

    def skip(state: Column, _: Column) -> Column:
        units = O.be(data, state["at"], 1)
        stop = (state["at"] + units * 4).cast("int")
        return F.when((state["next"] == 0) | (units == 0), state).otherwise(F.struct(stop.alias("at"), O.be(data, stop - 1, 1).alias("next")))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.col("end") - at) / 4).cast("int")))
    walked = F.aggregate(steps, start, skip)
    return F.when(any_of == 0, at + 8).when(LAYERS["GTP_U"].raw("e") == 0, at + 12).otherwise(F.when(walked["next"] == 0, walked["at"]))


def inner(df: DataFrame) -> DataFrame:
    """The frames inside of the tunnels of a capture, by the columns of the capture and `tunnel`, `tunnel_key`.

    One level is opened, a second call opens the next. num, time and other columns are those of the outer packet; data,
    wirelen and linktype are the inner frame's; columns named tunnel or tunnel_key are replaced. Tunnels are VXLAN,
    Geneve and GRE (bridged Ethernet and IP), GTP-U user data and PPPoE sessions with IP. tunnel_key is the VNI, TEID, session or GRE key, null
    for GRE without one. Packets without a tunnel, with null data or with a header that is cut off give no row; GRE with
    source routes or of version 1 neither. Equal packets give equal rows.
    """
    raw = lambda layer, name: LAYERS[layer].raw(name)
    data, off = F.col("data"), lambda layer: F.col(f"off_{layer}")
    link = lambda kind: F.when(kind == BRIDGED, ETHERNET).when(kind.isin(*_IP), BARE_IP)
    gre = off("GRE") + 4 + 4 * raw("GRE", "chksum_present")
    gre_key = F.when(raw("GRE", "key_present") == 1, O.be(data, gre, 4))
    plain = (raw("GRE", "routing_present") == 0) & (raw("GRE", "version") == 0)
    ppp = O.be(data, off("PPPoE") + 6, 2)
    found = [
        ("VXLAN", raw("VXLAN", "vni"), off("VXLAN") + 8, F.when(off("VXLAN").isNotNull(), ETHERNET)),
        ("Geneve", raw("Geneve", "vni"), off("Geneve") + 8 + 4 * raw("Geneve", "optlen"), link(raw("Geneve", "proto"))),
        ("GRE", gre_key, gre + 4 * raw("GRE", "key_present") + 4 * raw("GRE", "seqnum_present"), F.when(plain, link(raw("GRE", "proto")))),
        ("GTP_U", raw("GTP_U", "teid"), _gtp_start(), F.when(raw("GTP_U", "type") == USER_DATA, BARE_IP)),
        ("PPPoE", raw("PPPoE", "sessionid"), off("PPPoE") + 8, F.when((raw("PPPoE", "code") == 0) & ppp.isin(*PPP_IP), BARE_IP)),
    ]
    parts = [F.when(at.isNotNull() & kind.isNotNull(), F.struct(off(name).alias("header"), F.lit(name).alias("name"), key.cast("bigint").alias("key"), at.cast("int").alias("at"), kind.cast("int").alias("link"))) for name, key, at, kind in found]
    # PPPoE tells its own length; what follows is padding
    d = dissect(df).withColumn("_t", F.least(*parts))  # the outermost one
    told = F.when(F.col("_t.name") == "PPPoE", F.least(F.length("data"), off("PPPoE") + 6 + raw("PPPoE", "len"))).otherwise(F.col("end"))
    d = d.withColumn("_stop", told.cast("int")).where(F.col("_t").isNotNull() & (F.col("_stop") > F.col("_t.at")))
    body = O.part(data, F.col("_t.at"), F.col("_stop") - F.col("_t.at"))
    new = {"data": body, "wirelen": F.length(body).cast("bigint"), "linktype": F.col("_t.link"), "tunnel": F.col("_t.name"), "tunnel_key": F.col("_t.key")}
    kept = [c for c in df.columns if c not in new]
    return d.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in new.items()])
