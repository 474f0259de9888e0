"""Values by a schema: tags and lengths of every form, parts that are missing, and octets that are cut off."""

from pyspark.sql import functions as F

from capquill.operators import asn1 as A


def of(tag, body):
    return bytes.fromhex(tag) + (bytes([len(body)]) if len(body) < 128 else b"\x84" + len(body).to_bytes(4)) + body


def read(spark, values, schema):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, b binary")
    return [r.v for r in df.select("k", A.decoded(F.col("b"), schema).alias("v")).orderBy("k").collect()]


def test_forms_of_tags_and_lengths(spark):
    schema = A.Sequence({"n": A.integer(), "flag": A.boolean(), "deep": A.SequenceOf(A.oid(), tags=(0xBF8101,)), "rest": A.Any()})
    plain = of("02", b"\xff") + of("01", b"\x00") + of("bf8101", of("06", bytes.fromhex("2b06010401")) + of("06", bytes.fromhex("8837"))) + of("04", b"x" * 300)
    endless = b"\x30\x80" + of("02", b"\x01\x00") + b"\xbf\x81\x01\x80" + of("06", b"\x2a") + b"\0\0" + b"\0\0" + b"after"
    got = read(spark, [of("30", plain), endless, of("30", b""), b"", None, b"\x30\x05\x02\x01", of("31", plain), of("30", of("01", b"\1") + b"\x02\x09\x01"), b"\x30\x80" * 40], schema)
    assert (got[0].n, got[0].flag, got[0].deep, bytes(got[0].rest.octets), got[0].rest.text) == (-1, False, ["1.3.6.1.4.1", "2.999"], b"x" * 300, "x" * 300)
    assert (got[1].n, got[1].flag, got[1].deep, got[1].rest) == (256, None, ["1.2"], None)
    assert tuple(got[2]) == (None,) * 4 and got[3:7] == [None] * 4 and (got[7].n, got[7].flag) == (None, True) and got[8] is None


def test_choices_and_unknown_parts(spark):
    schema = A.SequenceOf(A.Choice({"number": A.integer(), "name": A.text(0x80), "size": A.unsigned(0x41)}))
    (got,) = read(spark, [of("30", of("02", b"\x07") + of("05", b"") + of("80", "né".encode()) + of("41", b"\xff\xff") + of("02", b"1" * 9))], schema)
    assert [tuple(x) for x in got] == [(7, None, None), (None, "né", None), (None, None, 65535), (None, None, None)]


def test_every_prefix_is_read(spark):
    message = of("30", of("02", b"\x01") + of("04", b"public") + of("a0", of("02", b"\x05") + of("02", b"\0") + of("02", b"\0") + of("30", of("30", of("06", b"\x2b\x06") + of("05", b"")))))
    df = spark.createDataFrame([(n, message[:n]) for n in range(len(message) + 1)], "n int, b binary")
    got = A.snmp_bindings(df, F.col("b")).collect()
    assert [(r.n, r.version, r.community, r.kind, r.id, r.oid, r.value) for r in got] == [(len(message), 1, "public", "get", 5, "1.3.6", None)]
    names = spark.createDataFrame([("1.3", "org"), ("2", "joint")], "oid string, name string")
    rows = spark.createDataFrame([("1.3.6.1",), ("1.30",), ("1.3",), (None,)], "oid string")
    assert sorted(map(tuple, A.tree(rows, names).collect()), key=str) == sorted([("1.3.6.1", "org", "6.1"), ("1.30", None, None), ("1.3", "org", ""), (None, None, None)], key=str)
