"""Line dedup (operator 3): lines that are boilerplate of their site.

Pages become lines of text (block tags end a line, other tags vanish, scripts, styles and comments go). For
each host the pages that hold a line are counted by a pre-aggregated (host, line hash) key and divided by the
host's pages; lines above the ratio, on `least` pages or more, are dropped from every page of the host. Only
hashes of lines travel; a page meets its own dropped hashes again, never a whole host.

Nulls and ties: null html has no lines and yields empty text; a page whose url is null or has no host belongs
to no site and keeps its lines; a line counts once for each page, however often it is repeated there; a null
page_id is a page like any other; repeated rows count as pages each. Empty tables give no rows. Other
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm.common import KEEP, columns_or_null, same, table

RATIO, LEAST = 0.3, 3
#: Fixed patterns and entities of the extraction, shared with the SQL below.
NOISE = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/@?#]*@)?([^/:?#]+)"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 2))


def lines(html: Column) -> Column:
    """Text lines of a page, trimmed, without empty ones."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), NOISE, "\n"), BLOCK, "\n"), TAG, "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.array_remove(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text (kept lines) of each page."""
    p = columns_or_null(pages, page_id="bigint", url="string", html="string")
    p = p.select("page_id", F.xxhash64("url", "html").alias("rid"), host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines"))
    keys = p.select("page_id", "rid", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("key")).where("host <> ''").persist(KEEP)
    totals = p.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    often = keys.groupBy("host", "key").agg(F.count("*").alias("times")).where(F.col("times") >= least)
    often = often.join(totals, "host").where(F.col("times") > ratio * F.col("pages")).select("host", "key")
    gone = keys.join(often, ["host", "key"]).groupBy("page_id", "rid").agg(F.collect_set("key").alias("gone"))
    gone = gone.select(F.col("page_id").alias("of"), F.col("rid").alias("of_rid"), "gone")
    out = p.join(gone, same(F.col("page_id"), F.col("of")) & (F.col("rid") == F.col("of_rid")), "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), F.unhex(F.md5(x)))))
    out = out.select("page_id", "host", F.size("lines").cast("bigint").alias("n_lines"), left.alias("left"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))


ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 2)) AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{NOISE}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g') AS t
  FROM pages
), l AS (
  SELECT page_id, host, list_filter(list_transform(string_split(
           replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
         chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM p
), total AS (SELECT host, count(*) AS pages FROM l GROUP BY host
), often AS (
  SELECT c.host, list(c.line) AS gone
  FROM (SELECT host, line, count(*) AS times FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l WHERE host <> '') GROUP BY host, line) c
  JOIN total USING (host) WHERE times >= {LEAST} AND times > {RATIO} * pages GROUP BY c.host
), k AS (
  SELECT page_id, l.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept
  FROM l LEFT JOIN often ON l.host = often.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
