import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from capquill.llm import prefix_trie as P
from tests.llm.cases import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, words string, depth int, part int"


def turns_of(rows):
    """Turns (role, text) of each conversation, in order."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append(((turn is not None, turn or 0), key, role, text))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def rebuild(by):
    out = {}
    for c, own in by.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = by.get(base, [])[:h] + own[h:]
    return out


def brute(by):
    members = defaultdict(list)
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, who in members.items():
        sub = [x for x in members if x[: len(node)] == node]
        kids = [x for x in sub if len(x) == len(node) + 1]
        childless = [x for x in sub if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in sub)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in sub if x)
        ended = ",".join(map(str, sorted(c for c in who if len(by[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out[min(who), len(node)] = (parent, len(who), len(kids), len(childless), saved, hashlib.sha256(ended.encode()).hexdigest())
    return out


def check(df, by):
    rows = df.collect()
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows) and got == brute(by)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "w", 7, 8) for r in rows], SCHEMA)


def drawn(n, seed):
    r = random.Random(seed)
    return [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a b", "a", "", None, "c\td  e"])) for c in r.sample(range(-60, 400), n) for t in range(r.randrange(1, 6))]


@pytest.mark.parametrize("light", [1000, 3])
def test_drawn_conversations(spark, monkeypatch, light):
    monkeypatch.setattr(P, "LIGHT", light)  # with 3, nodes and conversations are looked up by broadcast too
    monkeypatch.setattr(P, "BLOCK_BITS", 3)
    monkeypatch.setattr(P, "APART", 3)
    rows = drawn(150, light)
    check(P.rebuilt_trie(frame(spark, rows)), rebuild(turns_of(rows)))
    check(P.prefix_trie(frame(spark, rows)), turns_of(rows))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "CHAIN", 50)
    long = [(7, t, "user", f"turn {t % 11}") for t in range(300)]
    copies = [(c, t, "user", f"same {t}") for c in range(40, 55) for t in range(3)]
    rows = long + copies + [(None, 1, "user", "x"), (0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, 1, "a", "user"), (0, None, None, None), (1, 5, "", ""), (-7, 1, "u", "x" * 100_000), (23, 1, "q", "r")]
    check(P.rebuilt_trie(frame(spark, rows)), rebuild(turns_of(rows)))
    check(P.prefix_trie(frame(spark, rows)), turns_of(rows))
    check(P.prefix_trie(frame(spark, [(3, 1, "q", "r")])), turns_of([(3, 1, "q", "r")]))
    empty = P.rebuilt_trie(frame(spark, rows).limit(0))
    assert empty.count() == P.prefix_trie(frame(spark, rows[-8:]).where("conv_id is null")).count() == 0
    assert empty.columns == P.prefix_trie(frame(spark, rows)).columns


def test_sample_table_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(P.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = P.op11_prefix_trie(spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
