"""Keys beyond what one field of a frame holds: conversations, users and clocks that larger tables have."""

from datetime import datetime

from pyspark.sql import functions as F

from capquill.operators import dissect as D
from capquill.operators import flows
from capquill.plans.queries import QUERIES
from tests.test_stack import MACS, ip
from tests.test_streams import segment

FAR = (3, 60_003, 65_539, (1 << 24) + 3, (1 << 40) + 3)


def conversations(spark, tmp_path):
    rows = [(c, t, role, f"{role} {c} {t}") for c in FAR for t, role in enumerate(("user", "assistant", "user"))]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_spliced_conversations_far_apart(spark, tmp_path):
    got = QUERIES["stream_splice"](spark, conversations(spark, tmp_path)).collect()
    assert sorted((r.conv_id, r.direction, r.kind) for r in got) == sorted((c, d, "message") for c in FAR for d in (0, 0, 1))


def test_records_of_conversations_far_apart(spark, tmp_path):
    got = QUERIES["tls_records"](spark, conversations(spark, tmp_path)).collect()
    assert sorted((r.conv_id, r.direction, r.length) for r in got) == sorted((c, d, len(f"{role} {c} {t}")) for c in FAR for t, (d, role) in enumerate(((0, "user"), (1, "assistant"), (0, "user"))))


def test_streams_over_ipv6_far_apart(spark, tmp_path):
    got = QUERIES["streams_v6"](spark, conversations(spark, tmp_path)).collect()
    assert sorted((r.conv_id, r.direction) for r in got) == sorted((c, d) for c in FAR for d in (0, 1))


def test_users_far_apart_share_no_window(spark, tmp_path):
    rows = [(n, datetime(2024, 1, 1, 12, n, 7, 172425), u, "{}") for n, u in enumerate((5, 65_541, 5, (1 << 20) + 5))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["session_window_flows"](spark, str(tmp_path)).collect()
    assert {r.session for r in got} == {"UDP 10.8.0.5:5000 > 10.0.0.1:5001"}
    assert sorted((r.start_us % 3_600_000_000, r.packets) for r in got) == [(7_172_425, 2), (67_172_425, 1), (187_172_425, 1)]


def test_a_clock_that_begins_anew(spark):
    """Stamps of 32 bits over several turns, of a clock that runs up to a week fast or slow, out of order too."""
    days, off = (0, 30, 100, 70, 49.7), (0.0, 1.5, -604_800.0, 604_800.0, 0.25)
    stamps = [int((d * 86_400 + o) * 1000 + 4_000_000_000) % 2**32 for d, o in zip(days, off)]
    frame = MACS + b"\x08\x00" + ip(6, segment(1, 2))
    rows = [(n, d * 86_400.0, s, frame) for n, (d, s) in enumerate(zip(days, stamps))]
    df = D.capture(spark.createDataFrame(rows, "num bigint, time double, stamp bigint, data binary"))
    got = {r.num: round(r.skew, 3) for r in flows.time_skew(D.dissect(df), F.col("stamp")).collect()}
    assert got == {n: -o for n, o in enumerate(off)}
