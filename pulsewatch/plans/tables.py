"""The given tables as metrics, messages, logs, rule changes and progress.

Each frame has a SQL twin (`*_SQL`) that the queries' reference SQL builds on.
"""

from pyspark.sql import functions as F

from pulsewatch.sources.rules import rules_frame

# One row per event and field: 10 resources x 5 names x 2 fields = 100 metric keys.
METRICS_SQL = """
  SELECT ts, event_id AS seq, 'server' || (user_id % 10) AS resource, event_type AS name,
         event_type || '.value' AS metric, value
  FROM events
  UNION ALL
  SELECT ts, event_id, 'server' || (user_id % 10), event_type, event_type || '.k',
         CAST(json_extract_string(props, '$.k') AS DOUBLE)
  FROM events"""

# The same with one resource per user, so that keys grow with the data.
USER_METRICS_SQL = """
  SELECT ts, event_id AS seq, 'user' || user_id AS resource, event_type || '.value' AS metric, value
  FROM events"""

OPS = ("=", ">", ">=", "<", "<=", "!=", "<>")

CHANGES_SQL = """
  SELECT 'r' || (user_id % 20) || ':' || event_type AS rule_id,
         'server' || (user_id % 10) AS resource, event_type || '.value' AS metric,
         CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 7
              WHEN 0 THEN '=' WHEN 1 THEN '>' WHEN 2 THEN '>=' WHEN 3 THEN '<'
              WHEN 4 THEN '<=' WHEN 5 THEN '!=' ELSE '<>' END AS op,
         value AS threshold, ts AS updated_at, event_id AS seq,
         CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 AS deleted
  FROM events"""

PROGRESS_SQL = """
  SELECT 'q' || (user_id % 3) AS query, event_id AS batch_id, ts,
         '{"metric":{"0":' || (CAST(json_extract_string(props, '$.k') AS INTEGER) // 20) || '}}'
           AS start_offset
  FROM events"""


# Declared, so that no job has to read file footers to learn them.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark, sf_dir, name):
    """One given table; times are compared as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k")


def _resource():
    return F.concat(F.lit("server"), (F.col("user_id") % 10).cast("string"))


def metrics(spark, sf_dir):
    """Events as long-form metric rows."""
    return metrics_of(table(spark, sf_dir, "events"))


def user_metrics(spark, sf_dir):
    """Events as metric rows with one resource per user: keys grow with the data."""
    return table(spark, sf_dir, "events").select(
        "ts",
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("resource"),
        F.concat_ws(".", "event_type", F.lit("value")).alias("metric"),
        "value",
    )


def metrics_of(events):
    """The same for any frame, batch or stream, with the columns of `events`."""
    fields = F.array(
        F.struct(F.lit("value").alias("field"), F.col("value").alias("value")),
        F.struct(F.lit("k").alias("field"), _k().cast("double").alias("value")),
    )
    return events.select(
        "ts",
        F.col("event_id").alias("seq"),
        _resource().alias("resource"),
        F.col("event_type").alias("name"),
        F.inline(fields),
    ).select("ts", "seq", "resource", "name", F.concat_ws(".", "name", "field").alias("metric"), "value")


def event_stream(spark, sf_dir):
    """Events as a file stream, their time as TIMESTAMP so that it can be watermarked."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    files = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet")
    return files.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def metric_messages(spark, sf_dir):
    """Events as nested JSON messages. Even events carry their own time in whole seconds,
    odd ones are timed by their receipt; a text field rides along."""
    stamp = F.when(F.col("event_id") % 2 == 0, F.unix_timestamp(F.col("ts").cast("timestamp")))
    body = F.struct(
        F.col("event_type").alias("name"),
        F.struct(_resource().alias("host")).alias("tags"),
        F.struct("value", _k().cast("long").alias("k"), F.lit("ok").alias("note")).alias("fields"),
        stamp.alias("timestamp"),
    )
    return _messages(table(spark, sf_dir, "events"), body)


def flat_messages(spark, sf_dir):
    """Events as flat JSON messages."""
    body = F.struct(
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("nodegroup"),
        _resource().alias("resource"),
        F.col("event_type").alias("metric"),
        "value",
    )
    return _messages(table(spark, sf_dir, "events"), body)


def _messages(events, body):
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").alias("seq"),
        F.to_json(body).alias("value"),
    )


def log_messages(spark, sf_dir):
    """Documents as JSON log messages; the reading of a document is its length, as text."""
    body = F.struct(
        F.col("source").alias("nodegroup"),
        F.col("lang").alias("resource"),
        F.concat(F.lit("doc."), "lang").alias("event"),
        F.col("n_chars").cast("string").alias("metric"),
        F.col("text").alias("log"),
    )
    return table(spark, sf_dir, "documents").select(
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"),
        F.col("doc_id").alias("seq"),
        F.to_json(body).alias("value"),
    )


def logs(spark, sf_dir):
    """Documents as log rows."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.col("source").alias("nodegroup"),
        F.col("lang").alias("resource"),
        F.concat(F.lit("doc."), "lang").alias("event"),
        F.col("n_chars").cast("double").alias("metric"),
        F.col("text").alias("log"),
    )


def rule_changes(spark, sf_dir):
    """Every event as a change of one of 100 rules, two on each `.value` key."""
    return rule_changes_of(table(spark, sf_dir, "events"))


def rule_changes_of(events):
    """The same for any frame with the columns of `events`."""
    k = _k().cast("int")
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), k % 7 + 1)
    return events.select(
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string"), F.lit(":"), "event_type").alias("rule_id"),
        _resource().alias("resource"),
        F.concat("event_type", F.lit(".value")).alias("metric"),
        op.alias("op"),
        F.col("value").alias("threshold"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
        (k < 10).alias("deleted"),
    )


def progress(spark, sf_dir):
    """Every event as one trigger of one of three streaming queries."""
    part = F.floor(_k().cast("int") / 20).cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("query"),
        F.col("event_id").alias("batch_id"),
        "ts",
        F.concat(F.lit('{"metric":{"0":'), part, F.lit("}}")).alias("start_offset"),
    )


def values_sql(rows, columns):
    """Rule dicts as a SQL VALUES list with the given columns (name -> SQL type)."""

    def literal(value, kind):
        if value is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return f"CAST({value} AS {kind})"

    lines = [
        "(" + ", ".join(literal(row.get(c), kind) for c, kind in columns.items()) + ")" for row in rows
    ]
    names = ", ".join(columns)
    return f"SELECT * FROM (VALUES {', '.join(lines)}) AS t({names})"


def rule_rows(spark, rules):
    """Rule dicts as a Spark frame."""
    return rules_frame(spark, rules)
