"""Benchmark decontamination (operator 7): prefix-filtered set join, in DataFrame operations only.

An item is the set of its windows of 13 words (a shorter item is one window). Windows and documents are
shingled. A first pass counts how often each of the benchmark's shingles occurs in the documents; that orders
them by rarity. A window needs all its shingles, so its prefix is the rarest one, and a window with a shingle
that never occurs is out. The second pass joins the documents' shingles with these prefixes alone; where the
window would begin and its length bound the candidates, each of which has its words cut from the document on
the spot. A hash of these words and then the words themselves are compared with the window. Texts are never
shuffled; documents go through both passes in blocks of `BLOCK` words that overlap by a window.

Shingle hashes (8 bytes each) and prefixes (five numbers each) are broadcast if there are at most
`MOST_BROADCAST` of them; with more, Spark joins by its own choice, and a shingle carries the words around it.

Nulls and ties: a null text has no words; so have texts of punctuation only. An item with a null item_id is
looked for but never listed; items with equal windows are all listed; repeated items count once. A null
doc_id is a document like any other; repeated rows all get the same result. Empty tables: no documents, no
rows; no items, nothing is hit. Other columns of the inputs are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm.common import KEEP, columns_or_null, same, table

WIDTH, SHINGLE, BLOCK = 13, 5, 1024
MOST_BROADCAST = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z in lower case; only those letters change."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _shingle(w: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from the 1-based place on, or of as many as there are (no shingle of a window has such a hash)."""
    return F.xxhash64(F.lit(size), *[F.get(w, at + (j - 1)) for j in range(size)])


def _shingled(docs: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """doc_id, rid, n, first, w, at, token: the documents' shingles of all sizes, out of blocks of words.

    w: the words of a block and `width` - 1 more on each side, first: the place of its first one in the document
    (from 0), at: the shingle's place in w (from 1), n: words of the document. Places are exploded and not hashes, so
    that hashing is compiled; the outer forms have no condition on an array's size, for which it would be made twice.
    """
    w = docs.select("doc_id", "rid", words(F.col("text")).alias("w"))
    begin = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK))
    margin = lambda b: F.least(b, F.lit(width - 1))
    blocks = F.transform(begin, lambda b: F.struct((b - margin(b)).alias("first"), margin(b).alias("margin"), F.slice(F.col("w"), b - margin(b) + 1, margin(b) + (BLOCK + width - 1)).alias("w")))
    d = w.select("doc_id", "rid", F.size("w").alias("n"), F.explode_outer(blocks).alias("b")).select("doc_id", "rid", "n", "b.*")
    places = F.sequence(F.col("margin") + 1, F.greatest(F.least(F.col("margin") + BLOCK, F.size("w")), F.lit(1)))
    d = d.select("doc_id", "rid", "n", "first", "w", F.explode_outer(places).alias("at"))
    tokens = [_shingle(F.col("w"), F.col("at"), g) for g in sizes]
    return d.select("*", (F.explode_outer(F.array(*tokens)) if len(tokens) > 1 else tokens[0]).alias("token"))


def _window_shingles(size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.col("length") - size + 1), lambda i: _shingle(F.col("window"), i, size))


def _prefixes(windows: DataFrame, tokens: DataFrame, often: DataFrame) -> DataFrame:
    """token, offset, wid, length: each window's rarest shingle (of equally rare ones the least hash), if all of them occur."""
    rare = tokens.join(often, "token", "left").groupBy("wid", "window").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token", "offset")).alias("rare"))
    return rare.where("rare.times > 0").select("rare.token", "rare.offset", "wid", F.size("window").alias("length"))


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (item_id, wid, window, length); wid is a hash of the window's words."""
    w = columns_or_null(items, item_id="bigint", text="string").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), width).alias("window"))
    return w.select("item_id", F.xxhash64("window").alias("wid"), "window", F.size("window").alias("length")).distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, rid (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    docs = columns_or_null(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("rid"), "text")
    named = item_windows(items, width).persist(KEEP)
    windows = named.select("wid", "window", "length").distinct()
    sizes = [r[0] for r in windows.select(F.least("length", F.lit(shingle)).alias("size")).distinct().orderBy("size").collect()]

    counted = docs.select("doc_id", "rid", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    if not sizes:
        return _result(counted, None)
    least = F.least("length", F.lit(shingle))
    hashes = F.coalesce(*[F.when(least == g, _window_shingles(g)) for g in sizes])
    tokens = windows.select("wid", "window", F.posexplode(hashes).alias("offset", "token")).persist(KEEP)
    wanted = tokens.select("token").distinct().persist(KEEP)
    small = max(wanted.count(), windows.count()) <= MOST_BROADCAST

    shingled = _shingled(docs, sizes, width)
    often = shingled.select("token").join(F.broadcast(wanted) if small else wanted, "token").groupBy("token").agg(F.count("*").alias("times"))
    prefix = _prefixes(windows, tokens, often)
    if small:
        met = shingled.join(F.broadcast(prefix), "token")
    else:  # a shuffled shingle takes along just the words around it
        around = F.greatest(F.col("at") - (width - 1), F.lit(1))
        near = shingled.select("doc_id", "rid", "n", (F.col("first") + around - 1).alias("first"), F.slice("w", around, 2 * width).alias("w"), (F.col("at") - around + 1).alias("at"), "token")
        met = near.join(prefix, "token")
    begin = F.col("at") - F.col("offset")  # in w; before 1 it is before the document
    candidates = met.where((begin >= 1) & (F.col("first") + begin - 1 + F.col("length") <= F.col("n")))
    candidates = candidates.select("doc_id", "rid", (F.col("first") + begin - 1).alias("start"), "wid", "length", F.slice("w", F.greatest(begin, F.lit(1)), F.col("length")).alias("found"))
    candidates = candidates.where(F.xxhash64("found") == F.col("wid"))
    verified = candidates.join(windows.select("wid", "window"), "wid").where("found = window").select("doc_id", "rid", "start", "length", "wid", "window").persist(KEEP)

    covered = verified.select("doc_id", "rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("doc_id", "rid").agg(F.count("*").alias("n_hit"))
    ids = verified.select("doc_id", "rid", "wid", "window").distinct().join(named.select("wid", "window", "item_id").where("item_id is not null"), ["wid", "window"]).select("doc_id", "rid", F.col("item_id").cast("string").alias("item")).distinct()
    ids = ids.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = covered.join(ids.withColumnsRenamed({"doc_id": "d", "rid": "r"}), same(F.col("doc_id"), F.col("d")) & (F.col("rid") == F.col("r")), "left").select(F.col("doc_id").alias("of"), F.col("rid").alias("of_rid"), "n_hit", "items")
    return _result(counted, both)


def _result(counted: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        out = counted.withColumns({"n_hit": F.lit(0), "items": F.lit(None).cast("array<string>")})
    else:
        out = counted.join(found, same(F.col("doc_id"), F.col("of")) & (F.col("rid") == F.col("of_rid")), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "rid", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("of"), F.col("rid").alias("of_rid")).distinct()
    return docs.join(bad, same(F.col("doc_id"), F.col("of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("of_rid")), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[pos0:pos0 + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos0 FROM b WHERE len(w) > 0)
), hit AS (
  SELECT p.doc_id, p.pos0, p.n, i.item_id
  FROM (SELECT doc_id, n, pos0, array_to_string(w[pos0:pos0 + n - 1], ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos0 FROM d CROSS JOIN (SELECT DISTINCT n FROM item))) p
  JOIN item i ON i.win = p.win AND i.n = p.n
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos0, pos0 + n)) AS pos FROM (SELECT DISTINCT doc_id, pos0, n FROM hit)) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
