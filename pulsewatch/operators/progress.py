"""Questions on the recorded progress of streaming queries.

A progress table has one row per trigger: `query, batch_id, ts, start_offset`.
"""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from pulsewatch.functions.times import ordinal
from pulsewatch.operators.ordered import last_known, previous
from pulsewatch.operators.rulebook import newest_rows
from pulsewatch.operators.sizing import keyed_join


def changes_only(entries, limit=None):
    """Entries without an offset, or with the offset of the entry before, left out."""
    real = entries.where(
        F.col("start_offset").isNotNull() & ~F.lower("start_offset").isin("null", "none")
    )
    seen = previous(real, ["query"], ["ts", "batch_id"], "start_offset", "_before", limit)
    return seen.where(~F.col("start_offset").eqNullSafe(F.col("_before"))).drop("_before")


def last_offset(entries):
    """Newest recorded offset per query."""
    slim = entries.select("query", "ts", "batch_id", "start_offset")
    return newest_rows(slim, ["query"], ["ts", "batch_id"]).select("query", "start_offset")


def offsets_as_of(entries, requests, limit=None):
    """For each request (`query, ts`), the offset its query was to resume from at that time.

    That is the entry before the first later one with `ts >= requested`: the last entry
    older than the request or, before the first entry, that one. After the last entry,
    and for a query with a single entry, there is none.
    """
    asked = requests.withColumn("_id", F.xxhash64(*requests.columns))
    # At equal times a request (0) sorts before an entry (1): only older entries count.
    timeline = entries.select(
        "query", "ts", F.lit(1).alias("_kind"), F.col("batch_id").alias("_seq"), F.col("start_offset").alias("_offset")
    ).unionByName(
        asked.withColumnRenamed("_id", "_seq").withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    filled = last_known(timeline, ["query"], ["ts", "_kind", "_seq"], "_offset", "_older", limit)
    position = ordinal("ts", "batch_id")
    ends = entries.groupBy("query").agg(
        F.min_by("start_offset", position).alias("_first"),
        F.max("ts").alias("_last"),
        F.count(F.lit(1)).alias("_entries"),
    )
    answers = filled.where("_kind = 0").select(*requests.columns, "_older")
    known = keyed_join(answers, ends, ["query"], "left", derived=True)
    inside = (F.col("_entries") >= 2) & (F.col("ts") <= F.col("_last"))
    offset = F.when(inside, F.coalesce("_older", "_first"))
    return known.select(*requests.columns, offset.alias("start_offset"))


def offset_at(entries, query, ts):
    """The same for one query and one time, as text or None."""
    mine = entries.where(F.col("query") == query)
    when = F.lit(ts).cast(entries.schema["ts"].dataType)
    position = ordinal("ts", "batch_id")
    found = mine.agg(
        F.max_by("start_offset", F.when(F.col("ts") < when, position)).alias("older"),
        F.min_by("start_offset", position).alias("first"),
        F.coalesce(F.max("ts") >= when, F.lit(False)).alias("inside"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not found["inside"] or found["n"] < 2:
        return None
    return found["older"] if found["older"] is not None else found["first"]


def batches_since(entries, ts):
    """Entries a return to `ts` would run again: from each query's first batch at or after it."""
    when = F.lit(ts).cast(entries.schema["ts"].dataType)
    first = (
        entries.where(F.col("ts") >= when)
        .groupBy("query")
        .agg(F.min("batch_id").alias("_from"))
    )
    joined = keyed_join(entries, first, ["query"], derived=True)
    return joined.where(F.col("batch_id") >= F.col("_from")).drop("_from")


def replay_options(spec, entries=None, query=None):
    """Source options that start a new checkpoint at `earliest`, `latest`, an offset JSON,
    an epoch time in milliseconds, or a date `yyyy-MM-dd HH:mm:ss` (UTC)."""
    text = str(spec).strip()
    if text in ("earliest", "latest"):
        return {"startingOffsets": text}
    if text.startswith("{"):
        json.loads(text)
        return {"startingOffsets": text}
    try:
        if text.lstrip("-").isdigit():
            moment = datetime.fromtimestamp(int(text) / 1000, timezone.utc)
        else:
            moment = datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc)
    except ValueError as err:
        raise ValueError(f"not a replay start: {spec!r}") from err
    offset = offset_at(entries, query, moment.strftime("%Y-%m-%d %H:%M:%S.%f"))
    if offset is None:
        raise ValueError(f"no offset recorded for {spec!r}")
    return {"startingOffsets": offset}


def history_line(ts="ts", offset="start_offset"):
    """Offset history text: epoch milliseconds, date and offset, separated by `#`."""
    millis = F.unix_millis(F.col(ts).cast("timestamp")).cast("string")
    return F.concat_ws("#", millis, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.col(offset))


def parse_history(lines, query):
    """Offset history text back as progress rows, in the order of their times."""
    parts = F.split("value", "#", 3)
    return lines.select(
        F.lit(query).alias("query"),
        F.get(parts, F.lit(0)).cast("long").alias("batch_id"),
        F.timestamp_millis(F.get(parts, F.lit(0)).cast("long")).alias("ts"),
        F.get(parts, F.lit(2)).alias("start_offset"),
    )
