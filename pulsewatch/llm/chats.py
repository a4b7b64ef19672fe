"""Logged conversations: snapshots that a longer one goes on from are collapsed, the rest rendered.

Each turn gets the hash of the conversation up to it. A conversation whose whole hash is
some other conversation's hash at an earlier turn is a snapshot of that one; the anti-join
that drops it compares distinct hashes, so a first turn that everybody shares costs one row.
"""

from pyspark.sql import functions as F

from pulsewatch.llm.common import read, stored
from pulsewatch.operators.ordered import running_sum

PART_TURNS = 256
START, END = "<|", "|>"
CLOSE = "<|end|>\n"
SALTS = (1, 2)


def prefixes(turns, order):
    """Turns with `pos` from 1 and `p1`, `p2`: 128 bits over all turns up to this one."""
    numbered = running_sum(turns.withColumn("one", F.lit(1)), ["conv_id"], order, "one", "pos").drop("one")
    parts = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    for salt in SALTS:
        term = F.xxhash64(F.lit(salt), *parts).cast("decimal(20,0)")
        numbered = numbered.withColumn(f"t{salt}", term)
        numbered = running_sum(numbered, ["conv_id"], order, f"t{salt}", f"p{salt}")
    return numbered.drop("_slice", "_k")


def collapse(conversations, part_turns=PART_TURNS, conv_id="conv_id", turn="turn", role="role", text="text"):
    """Maximal conversations, rendered: conv_id, part, n_turns, copies, rendered.

    Turns follow (turn, role, text), nulls first; equal rows are turns of their own. A
    conversation goes if its turns, by role and text, are the first turns of a longer one.
    Of equal conversations the smallest conv_id stays (null last) and `copies` counts them.
    Rows without conv_id form one conversation. Null roles and texts are rendered as empty
    and differ from empty ones. A conversation is rendered in parts of `part_turns` turns,
    numbered from 0, so that none has to fit a row; a shorter one has a single part.
    Further columns are ignored; an empty table gives an empty result.
    """
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    rows = stored(prefixes(turns, ["turn", "role", "text"]), "turns")
    whole = rows.groupBy("conv_id").agg(F.max("pos").alias("pos"), *[F.sum(f"t{s}").alias(f"p{s}") for s in SALTS])
    whole = whole.select("conv_id", "pos", *[F.col(f"p{s}").cast("decimal(38,0)").alias(f"p{s}") for s in SALTS])
    key = ["pos", "p1", "p2"]
    kept_id = F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("conv_id")))["conv_id"]
    equal = stored(whole.groupBy(*key).agg(kept_id.alias("conv_id"), F.count(F.lit(1)).alias("copies")), "whole")
    reached = rows.select("pos", *[F.col(f"p{s}").cast("decimal(38,0)").alias(f"p{s}") for s in SALTS])
    reached = reached.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    # A prefix that more conversations reach than end with goes on in some of them.
    going_on = reached.join(equal.select(*key, "copies"), key).where("n > copies").select(*key)
    maximal = equal.join(going_on, key, "left_anti").select(
        F.col("conv_id").alias("id"), F.col("pos").alias("n_turns"), "copies"
    )
    said = F.concat(
        F.lit(START), F.coalesce("role", F.lit("")), F.lit(END + "\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE)
    )
    lines = rows.select("conv_id", "pos", F.floor((F.col("pos") - 1) / part_turns).cast("long").alias("part"), said.alias("said"))
    own = lines.join(maximal, F.col("conv_id").eqNullSafe(F.col("id")))
    parts = own.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("s"))
    rendered = F.array_join(F.col("s.said"), "")
    return parts.select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), "copies", rendered.alias("rendered"))


def op1_chat_formatting(spark, sf_dir):
    return collapse(read(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n'), '')
      OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), whole AS (
  SELECT prefix, pos, coalesce(min(conv_id), NULL) AS conv_id, count(*) AS copies FROM t WHERE pos = n GROUP BY ALL
), maximal AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pos < t.n AND t.pos = whole.pos AND t.prefix = whole.prefix)
)
SELECT t.conv_id, CAST((t.pos - 1) // {PART_TURNS} AS BIGINT) AS part, CAST(m.pos AS BIGINT) AS n_turns, m.copies,
  string_agg('{START}' || coalesce(role, '') || '{END}' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM t JOIN maximal m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
GROUP BY ALL
"""
