"""Chat formatting (operator 6): multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and
all others as named users; only what the assistant says is trained on (its text and the end marker). System
turns stay system turns in every rendering and the system is no participant. The turns of a conversation travel once
and are rotated where they meet. A rendering is one row, whatever its length, so a task holds one dialogue at a time.

A text or role can't forge a turn: `<|` in them is written `<\\|`, and a line break in a role is a blank.

Nulls and ties: a null text is rendered empty; a turn with a null role is an unnamed user and no participant;
turns with a null number come first; equal turns are ordered by role and text, nulls first, and
repeated rows are rendered as often as they occur. A null conv_id is one conversation. Conversations without
a participant, and empty tables, give no rows. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capquill.llm.common import columns_or_null, table

SYSTEM = "system"
#: Fixed markers of the rendered format.
START, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _header(role: Column, me: Column) -> Column:
    named = F.concat(F.lit("user name="), F.replace(_plain(role), F.lit("\n"), F.lit(" ")))
    who = F.when(role == me, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM)).when(role.isNull(), F.lit("user")).otherwise(named)
    return F.concat(F.lit(START), who, F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, n_trained, text, and mask: [start, end) characters of text to train on."""
    c = columns_or_null(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    d = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r.isNotNull() & (r != SYSTEM)))
    d = d.select("conv_id", F.explode(speakers).alias("perspective"), "turns")

    def say(t: Column) -> Column:
        body = F.concat(_plain(F.coalesce(t["text"], F.lit(""))), F.lit(END))
        return F.struct(_header(t["role"], F.col("perspective")).alias("head"), body.alias("body"), F.coalesce(t["role"] == F.col("perspective"), F.lit(False)).alias("mine"))

    d = d.select("conv_id", "perspective", F.transform("turns", say).alias("said"))

    def add(done: Column, s: Column) -> Column:
        at = done["at"] + F.char_length(s["head"])
        end = at + F.char_length(s["body"])
        mask = F.when(s["mine"], F.concat(done["mask"], F.array(F.struct(at.alias("start"), end.alias("end"))))).otherwise(done["mask"])
        return F.struct((end + 1).alias("at"), mask.alias("mask"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return d.select(
        "conv_id", "perspective", F.size("said").cast("bigint").alias("n_turns"), F.size(F.filter("said", lambda s: s["mine"])).cast("bigint").alias("n_trained"),
        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"), F.aggregate("said", start, add)["mask"].alias("mask"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ","))


ORACLE_SQL = f"""
WITH who AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> '{SYSTEM}'
), m AS (
  SELECT c.conv_id, perspective, turn, role, text, coalesce(role = perspective, false) AS mine,
         '{START}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = '{SYSTEM}' THEN 'system' WHEN role IS NULL THEN 'user'
                      ELSE 'user name=' || replace(replace(role, '<|', '<\\|'), chr(10), ' ') END || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '<\\|') || '{END}' AS body
  FROM conversations c JOIN who ON c.conv_id IS NOT DISTINCT FROM who.conv_id
), o AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(body) + 1) OVER w AS upto FROM m
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (mine) AS n_trained, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(upto - length(body) - 1 AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ',' ORDER BY k) FILTER (mine), '') AS mask
FROM o GROUP BY conv_id, perspective
"""
