"""Registered queries: one per operator, over whole tables, most with reference SQL."""

import re

from pyspark.sql import functions as F

from pulsewatch.functions.averages import user_avg
from pulsewatch.functions.encode import encode_alarm
from pulsewatch.functions.predicates import FilterGroup, raw_condition, threshold_condition
from pulsewatch.operators import cep, continuous, counts, detect, lookup, normalize, views, windows
from pulsewatch.operators import progress as ops
from pulsewatch.operators.rulebook import current_rules
from pulsewatch.plans import tables as given
from pulsewatch.plans.tables import (
    CHANGES_SQL,
    METRICS_SQL,
    PROGRESS_SQL,
    metrics,
    progress,
    rule_changes,
    rule_rows,
    values_sql,
)
from pulsewatch.session import cut_lineage, run_dir
from pulsewatch.sources.messages import MESSAGE, read_messages
from pulsewatch.sources.rules import load_rules
from pulsewatch.sources.tables import batch_stream, read_batches
from pulsewatch.streaming import live, streaks

QUERIES = {}
ORACLES = {}

# Lookups are made at a fixed time, so that the answers do not depend on the clock.
AS_OF = "2024-01-31 00:00:00"

THRESHOLDS = [
    {"rule_id": "t1", "resource": "server1", "metric": "click.value", "op": ">", "threshold": 50.0},
    {"rule_id": "t2", "resource": "server1", "metric": "click.value", "op": "<=", "threshold": 10.0},
    {"rule_id": "t3", "resource": "server2", "metric": "error.k", "op": ">=", "threshold": 50.0},
    {"rule_id": "t4", "resource": "server3", "metric": "view.k", "op": "=", "threshold": 42.0},
    {"rule_id": "t5", "resource": "server4", "metric": "purchase.value", "op": "<", "threshold": 20.0},
    {"rule_id": "t6", "resource": "server5", "metric": "signup.k", "op": "!=", "threshold": 7.0},
    {"rule_id": "t7", "resource": "server6", "metric": "error.value", "op": "<>", "threshold": 1.5},
    {"rule_id": "t8", "resource": "server7", "metric": "view.value", "op": "~", "threshold": 1.0},
    {"rule_id": "t9", "resource": "server99", "metric": "view.value", "op": ">", "threshold": 1.0},
    {"rule_id": "t10", "resource": "server0", "metric": "error.k", "op": ">", "threshold": 20.0},
]
THRESHOLD_COLUMNS = {
    "rule_id": "VARCHAR", "resource": "VARCHAR", "metric": "VARCHAR", "op": "VARCHAR", "threshold": "DOUBLE",
}
RULES_SQL = values_sql(THRESHOLDS, THRESHOLD_COLUMNS)

CONTINUOUS = [
    {"rule_id": "c1", "target_rule_id": "t1", "mark_count": 3},
    {"rule_id": "c2", "target_rule_id": "t3", "mark_count": 3},
    {"rule_id": "c3", "target_rule_id": "t3", "mark_count": 5},
    {"rule_id": "c4", "target_rule_id": "t6", "mark_count": 20},
]
CONTINUOUS_SQL = values_sql(
    CONTINUOUS, {"rule_id": "VARCHAR", "target_rule_id": "VARCHAR", "mark_count": "BIGINT"}
)


def holds_sql(value, op, threshold, missing="false"):
    """A rule's comparison in SQL; `missing` is the answer for an unknown operator."""
    cases = " ".join(
        f"WHEN {op} = '{o}' THEN {value} {o} {threshold}" for o in given.OPS
    )
    return f"(CASE WHEN {value} IS NULL THEN {missing} {cases} ELSE {missing} END)"


DETECT_SQL = f"""
  SELECT m.ts, m.seq, m.resource, m.metric, m.value, r.rule_id, r.op, r.threshold,
         {holds_sql('m.value', 'r.op', 'r.threshold')} AS detect
  FROM m JOIN r ON m.resource = r.resource AND m.metric = r.metric"""

LATEST_SQL = """
  SELECT resource, metric, arg_max(value, row(ts, seq)) AS value, max(ts) AS ts,
         arg_max(seq, row(ts, seq)) AS seq
  FROM m GROUP BY resource, metric"""


def _bucket(size, ts="ts"):
    return f"time_bucket(INTERVAL '{size}', {ts}, TIMESTAMP '1970-01-01')"


def rollup_sql(size):
    start = _bucket(size)
    return f"""
  SELECT {start} AS window_start, {start} + INTERVAL '{size}' AS window_end, resource, metric,
         count(value) AS cnt, avg(value) AS mean, min(value) AS min, max(value) AS max,
         stddev_samp(value) AS stddev
  FROM m GROUP BY ALL"""


STREAK_SQL = """
  SELECT *, CASE WHEN detect THEN sum(CASE WHEN detect THEN 1 ELSE 0 END) OVER (
              PARTITION BY rule_id, grp ORDER BY ts, seq, metric, value NULLS FIRST ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak
  FROM (SELECT *, sum(CASE WHEN detect THEN 0 ELSE 1 END) OVER (
              PARTITION BY rule_id ORDER BY ts, seq, metric, value NULLS FIRST ROWS UNBOUNDED PRECEDING) AS grp FROM d)"""


def with_sql(body, **ctes):
    """A query over named sub-queries; `m` is the metric rows and `r` the threshold rules."""
    named = {"m": METRICS_SQL, "r": RULES_SQL, **ctes}
    return "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in named.items()) + body


def query(name, sql=None):
    """Register a query under `name`, with its reference SQL where there is one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df, *columns):
    """Doubles to 6 places, the precision results are compared at."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def plain_times(df, *columns):
    """TIMESTAMP columns as zone-less times, as the tables hold them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def thresholds(spark):
    return rule_rows(spark, THRESHOLDS)


def detections(spark, sf_dir):
    return detect.detect(metrics(spark, sf_dir), thresholds(spark))


# Parsing and projection


@query(
    "normalize_metrics",
    """
    SELECT CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END AS ts,
           event_id AS seq, 'server' || (user_id % 10) AS resource, event_type AS name,
           event_type || '.' || field AS metric, value
    FROM (SELECT *, 'value' AS field FROM events
          UNION ALL
          SELECT * REPLACE (CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value), 'k' FROM events)""",
)
def normalize_metrics(spark, sf_dir):
    parsed = normalize.metrics(given.metric_messages(spark, sf_dir))
    return plain_times(parsed, "ts").select("ts", "seq", "resource", "name", "metric", "value")


@query("message_files", ORACLES["normalize_metrics"])
def message_files(spark, sf_dir):
    """The same messages written to files and read as a message source."""
    path = run_dir(spark, "messages")
    sent = given.metric_messages(spark, sf_dir).withColumn("key", F.lit("k"))
    sent.select("timestamp", "key", "value", "seq").write.parquet(path)
    read = read_messages(spark, "parquet", path, MESSAGE + ", seq long", stream=False)
    return plain_times(normalize.metrics(read), "ts").select("ts", "seq", "resource", "name", "metric", "value")


@query("stream_message_files", ORACLES["normalize_metrics"])
def stream_message_files(spark, sf_dir):
    """The same as a stream into a table."""
    base = run_dir(spark, "message-stream")
    sent = given.metric_messages(spark, sf_dir).withColumn("key", F.lit("k"))
    sent.select("timestamp", "key", "value", "seq").write.parquet(f"{base}/in")
    read = read_messages(spark, "parquet", f"{base}/in", MESSAGE + ", seq long", maxFilesPerTrigger=1)
    parsed = normalize.metrics(read).select("ts", "seq", "resource", "name", "metric", "value")
    _finish(live.start_table(parsed, f"{base}/out", f"{base}/checkpoint", available_now=True))
    return plain_times(spark.read.schema(parsed.schema).parquet(f"{base}/out"), "ts")


@query(
    "normalize_flat",
    """
    SELECT ts, event_id AS seq, 'g' || (user_id % 3) AS dc, 'server' || (user_id % 10) AS resource,
           event_type AS metric, value
    FROM events""",
)
def normalize_flat(spark, sf_dir):
    parsed = normalize.flat_metrics(given.flat_messages(spark, sf_dir))
    return plain_times(parsed, "ts").drop("name")


@query(
    "normalize_logs",
    """
    SELECT doc_id AS seq, source AS nodegroup, lang AS resource, 'doc.' || lang AS event,
           CAST(n_chars AS DOUBLE) AS metric, text AS log
    FROM documents""",
)
def normalize_logs(spark, sf_dir):
    return normalize.logs(given.log_messages(spark, sf_dir)).drop("ts")


@query("rejected_messages", "SELECT doc_id AS seq, md5(text) AS digest FROM documents")
def rejected_messages(spark, sf_dir):
    """Documents are no metric messages; the events sent along with them are."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp")
    texts = given.table(spark, sf_dir, "documents").select(
        now, F.col("doc_id").alias("seq"), F.col("text").alias("value")
    )
    mixed = texts.unionByName(given.metric_messages(spark, sf_dir))
    return normalize.rejected(mixed).select("seq", F.md5("value").alias("digest"))


@query(
    "alarm_json",
    with_sql(
        """
    SELECT 'simple' AS alarm_type, rule_id, detect, CAST(detect AS INTEGER) AS occur_count,
           ts AS occur_timestamp, seq, value AS metric_value,
           rule_id AS payload_rule, threshold AS payload_threshold
    FROM d""",
        d=DETECT_SQL,
    ),
)
def alarm_json(spark, sf_dir):
    sent = detect.simple_alarms(detections(spark, sf_dir)).select(
        F.col("occur_timestamp").cast("timestamp").alias("timestamp"), "seq", encode_alarm().alias("value")
    )
    read = normalize.alarms(sent).withColumns(
        {
            "metric_value": F.get_json_object("payload", "$.metric.value").cast("double"),
            "payload_rule": F.get_json_object("payload", "$.rule.ruleId"),
            "payload_threshold": F.get_json_object("payload", "$.rule.value").cast("double"),
        }
    )
    return plain_times(read.drop("received", "payload"), "occur_timestamp")


# Rule matching


@query("threshold_detect", with_sql(DETECT_SQL))
def threshold_detect(spark, sf_dir):
    return detections(spark, sf_dir).drop("name")


@query(
    "threshold_check",
    with_sql("SELECT ts, seq, resource, metric, rule_id, CAST(detect AS INTEGER) AS chk FROM d", d=DETECT_SQL),
)
def threshold_check(spark, sf_dir):
    checked = detect.check(metrics(spark, sf_dir), thresholds(spark))
    return checked.select("ts", "seq", "resource", "metric", "rule_id", "chk")


NAME_RULES = [
    {"rule_id": "n1", "metric": "click", "op": ">", "threshold": 80.0},
    {"rule_id": "n2", "metric": "error", "op": "<", "threshold": 5.0},
    {"rule_id": "n3", "metric": "view", "op": "=", "threshold": 42.0},
]


@query(
    "event_name_join",
    with_sql(
        f"""
    SELECT n.rule_id, m.seq, m.name, m.metric, m.value,
           CAST({holds_sql('m.value', 'n.op', 'n.threshold')} AS INTEGER) AS chk
    FROM m JOIN n ON m.name = n.name""",
        n=values_sql(
            [{**r, "name": r["metric"]} for r in NAME_RULES],
            {"rule_id": "VARCHAR", "name": "VARCHAR", "op": "VARCHAR", "threshold": "DOUBLE"},
        ),
    ),
)
def event_name_join(spark, sf_dir):
    rules = rule_rows(spark, NAME_RULES).withColumnRenamed("metric", "name")
    checked = detect.check(metrics(spark, sf_dir), rules, keys=("name",))
    return checked.select("rule_id", "seq", "name", "metric", "value", "chk")


@query(
    "filter_logic",
    with_sql(
        """
    SELECT seq, resource, metric, value FROM m
    WHERE (resource = 'server1' AND metric = 'click.value' AND value > 50)
       OR (resource = 'server2' AND metric = 'error.k' AND value <= 30)
       OR (name = 'view' AND value >= 90 AND value <> 95)"""
    ),
)
def filter_logic(spark, sf_dir):
    either = FilterGroup("OR").add(threshold_condition("server1", "click.value", ">", 50.0))
    either = either.add(threshold_condition("server2", "error.k", "<=", 30.0))
    both = FilterGroup("AND", (raw_condition("name = 'view' AND value >= 90"), F.col("value") != 95))
    kept = metrics(spark, sf_dir).where(either.add(both).condition())
    return kept.select("seq", "resource", "metric", "value")


CURRENT_SQL = """
  SELECT rule_id, resource, metric, op, threshold, updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY updated_at DESC, seq DESC) AS rn
    FROM changes) WHERE rn = 1 AND NOT deleted"""


@query("rule_current", f"WITH changes AS ({CHANGES_SQL}) {CURRENT_SQL}")
def rule_current(spark, sf_dir):
    return current_rules(rule_changes(spark, sf_dir))


@query(
    "rules_per_metric",
    f"WITH changes AS ({CHANGES_SQL}), r AS ({CURRENT_SQL}) "
    "SELECT metric, count(*) AS cnt FROM r GROUP BY metric",
)
def rules_per_metric(spark, sf_dir):
    return counts.rules_per_metric(current_rules(rule_changes(spark, sf_dir)))


@query(
    "dynamic_rule_join",
    with_sql(
        f"""
    SELECT m.seq, m.resource, m.metric, b.rule_id,
           CAST({holds_sql('m.value', 'b.op', 'b.threshold')} AS INTEGER) AS chk
    FROM m JOIN b ON m.resource = b.resource AND m.metric = b.metric""",
        changes=CHANGES_SQL,
        b=f"SELECT rule_id, resource, metric, op, threshold FROM r UNION ALL "
        f"SELECT rule_id, resource, metric, op, threshold FROM ({CURRENT_SQL})",
    ),
)
def dynamic_rule_join(spark, sf_dir):
    learned = cut_lineage(current_rules(rule_changes(spark, sf_dir)))
    rules = detect.both_rule_sets(thresholds(spark), learned)
    checked = detect.check(metrics(spark, sf_dir), rules)
    return checked.select("seq", "resource", "metric", "rule_id", "chk")


@query(
    "last_rule_lookup",
    with_sql(
        f"""
    SELECT m.seq, m.resource, m.metric, l.rule_id,
           CAST({holds_sql('m.value', 'l.op', 'l.threshold')} AS INTEGER) AS chk
    FROM m JOIN l ON m.resource = l.resource AND m.metric = l.metric""",
        changes=CHANGES_SQL,
        l="""SELECT * FROM (SELECT *, row_number() OVER (
               PARTITION BY resource, metric ORDER BY updated_at DESC, seq DESC) AS rn FROM changes)
             WHERE rn = 1""",
    ),
)
def last_rule_lookup(spark, sf_dir):
    rules = cut_lineage(detect.last_rule_per_key(rule_changes(spark, sf_dir)))
    checked = detect.check(metrics(spark, sf_dir), rules)
    return checked.select("seq", "resource", "metric", "rule_id", "chk")


@query(
    "has_rule",
    with_sql(
        """
    SELECT ts, seq, resource, metric, value FROM m
    WHERE EXISTS (SELECT 1 FROM r WHERE r.resource = m.resource AND r.metric = m.metric)"""
    ),
)
def has_rule(spark, sf_dir):
    return detect.has_rule(metrics(spark, sf_dir), thresholds(spark)).drop("name")


@query(
    "any_rule",
    with_sql("SELECT DISTINCT ts, seq, resource, metric, value FROM d WHERE detect", d=DETECT_SQL),
)
def any_rule(spark, sf_dir):
    return detect.any_rule_matches(metrics(spark, sf_dir), thresholds(spark)).drop("name")


ORDERED_RULES = [
    {"rule_id": "f1", "resource": "server1", "metric": "click.value", "op": ">", "threshold": 80.0},
    {"rule_id": "f2", "resource": "server1", "metric": "click.value", "op": ">", "threshold": 20.0},
    {"rule_id": "f3", "resource": "server1", "metric": "click.value", "op": "<=", "threshold": 5.0},
    {"rule_id": "f4", "resource": "server2", "metric": "view.k", "op": "!=", "threshold": 3.0},
]


FIRST_SQL = f"""
    SELECT seq, resource, metric, value, id, CAST(id <> '' AS INTEGER) AS chk FROM (
      SELECT m.seq, m.resource, m.metric, m.value, coalesce(
        (SELECT arg_min(o.rule_id, o.rule_order) FROM o WHERE m.resource = o.resource AND m.metric = o.metric
               AND {holds_sql('m.value', 'o.op', 'o.threshold')}), '') AS id
      FROM {{rows}} m)"""
ORDERED_SQL = values_sql(
    [{**r, "rule_order": i} for i, r in enumerate(ORDERED_RULES)], {**THRESHOLD_COLUMNS, "rule_order": "BIGINT"}
)
TWICE_SQL = "(SELECT * FROM m UNION ALL SELECT * FROM m WHERE seq % 3 = 0)"


def first_matches(spark, rows, **options):
    rules = rule_rows(spark, [{**r, "seq": i} for i, r in enumerate(ORDERED_RULES)])
    found = detect.first_match(rows, rules, order="seq", **options)
    return found.select("seq", "resource", "metric", "value", "id", "chk")


@query("first_match", with_sql(FIRST_SQL.format(rows="m"), o=ORDERED_SQL))
def first_match(spark, sf_dir):
    return first_matches(spark, metrics(spark, sf_dir))


@query("first_match_repeated", with_sql(FIRST_SQL.format(rows=TWICE_SQL), o=ORDERED_SQL))
def first_match_repeated(spark, sf_dir):
    """A third of the rows come twice and stay two."""
    rows = metrics(spark, sf_dir)
    return first_matches(spark, rows.unionAll(rows.where("seq % 3 = 0")))


@query("first_match_spread", with_sql(FIRST_SQL.format(rows=TWICE_SQL), o=ORDERED_SQL))
def first_match_spread(spark, sf_dir):
    """The same with rules too many to broadcast."""
    rows = metrics(spark, sf_dir)
    return first_matches(spark, rows.unionAll(rows.where("seq % 3 = 0")), spread=True)


LOG_RULES = [
    {"rule_id": "l1", "resource": None, "op": "like", "keyword": "error"},
    {"rule_id": "l2", "resource": "en", "op": "like", "keyword": "the "},
    {"rule_id": "l3", "resource": None, "op": "like", "keyword": "%"},
    {"rule_id": "l4", "resource": "fr", "op": "!=", "keyword": "ERROR"},
    {"rule_id": "l5", "resource": None, "op": "=", "keyword": "ERROR"},
    {"rule_id": "l6", "resource": "de", "op": "like", "keyword": "Copyright"},
]


@query(
    "log_rule",
    f"""
    WITH l AS ({values_sql(LOG_RULES, {'rule_id': 'VARCHAR', 'resource': 'VARCHAR', 'op': 'VARCHAR', 'keyword': 'VARCHAR'})})
    SELECT l.rule_id, d.doc_id AS seq, d.lang AS resource
    FROM documents d JOIN l ON l.resource IS NULL OR l.resource = d.lang
    WHERE CASE l.op WHEN '=' THEN d.text = l.keyword WHEN '!=' THEN d.text <> l.keyword
                    WHEN 'like' THEN contains(d.text, l.keyword) END""",
)
def log_rule(spark, sf_dir):
    hits = detect.detect_logs(given.logs(spark, sf_dir), rule_rows(spark, LOG_RULES))
    return hits.select("rule_id", "seq", "resource")


@query(
    "detect_counts",
    with_sql(
        "SELECT metric, CAST(detect AS INTEGER) AS chk, count(*) AS cnt FROM d GROUP BY ALL", d=DETECT_SQL
    ),
)
def detect_counts(spark, sf_dir):
    return counts.detect_counts(detect.check(metrics(spark, sf_dir), thresholds(spark)))


@query(
    "detect_running",
    with_sql(
        """
    SELECT b.day, metric, not_detected, detected, batch_count, total_count FROM b JOIN (
      SELECT day, CAST(sum(sum(batch_count)) OVER (ORDER BY day) AS BIGINT) AS total_count
      FROM b GROUP BY day) t ON b.day = t.day""",
        d=DETECT_SQL,
        b="""SELECT CAST(ts AS DATE) AS day, metric,
               CAST(count_if(NOT detect) AS BIGINT) AS not_detected,
               CAST(count_if(detect) AS BIGINT) AS detected, count(*) AS batch_count
             FROM d GROUP BY ALL""",
    ),
)
def detect_running(spark, sf_dir):
    checked = detect.check(metrics(spark, sf_dir), thresholds(spark))
    daily = counts.batch_counts(checked.withColumn("day", F.to_date("ts")), "day")
    return counts.running_counts(daily, "day")


# Views and lookups


@query("state_view", with_sql(LATEST_SQL))
def state_view(spark, sf_dir):
    return views.latest(metrics(spark, sf_dir))


@query(
    "recent_state",
    with_sql(
        f"""
    SELECT * FROM ({LATEST_SQL}) WHERE date_diff('second', ts, TIMESTAMP '{AS_OF}') <= 7200
    ORDER BY resource, metric"""
    ),
)
def recent_state(spark, sf_dir):
    state = views.state_view(metrics(spark, sf_dir), minutes=120, as_of=AS_OF)
    return views.sorted_state(state)


@query("state_view_users", f"WITH m AS ({given.USER_METRICS_SQL}) {LATEST_SQL}")
def state_view_users(spark, sf_dir):
    return views.latest(given.user_metrics(spark, sf_dir))


USER_RULES_SQL = f"""
  SELECT DISTINCT resource, metric, resource || ':' || metric AS rule_id, '>' AS op, CAST(50 AS DOUBLE) AS threshold
  FROM ({given.USER_METRICS_SQL})"""


@query(
    "threshold_users",
    f"WITH m AS ({given.USER_METRICS_SQL}), r AS ({USER_RULES_SQL}) "
    f"SELECT seq, rule_id, detect FROM ({DETECT_SQL})",
)
def threshold_users(spark, sf_dir):
    """A rule on every key of every user: a rule table that grows with the data."""
    rows = given.user_metrics(spark, sf_dir)
    rules = rows.select("resource", "metric").distinct().select(
        "resource", "metric", F.concat_ws(":", "resource", "metric").alias("rule_id"),
        F.lit(">").alias("op"), F.lit(50.0).alias("threshold"),
    )
    return detect.detect(rows, cut_lineage(rules)).select("seq", "rule_id", "detect")


LOOKED_UP = [("server1", "click.value"), ("server7", "view.k"), ("server99", "view.k")]


@query(
    "current_values",
    with_sql(
        f"""
    SELECT l.resource, l.metric, s.value FROM l LEFT JOIN ({LATEST_SQL}) s
    ON l.resource = s.resource AND l.metric = s.metric""",
        l=values_sql(
            [dict(zip(("resource", "metric"), k)) for k in LOOKED_UP], {"resource": "VARCHAR", "metric": "VARCHAR"}
        ),
    ),
)
def current_values(spark, sf_dir):
    """Single values looked up one by one, by the function and by SQL text on the registered view."""
    state = views.latest(metrics(spark, sf_dir))
    state.createOrReplaceTempView("state_view")
    rows = []
    for resource, metric in LOOKED_UP:
        one = views.current_value(state, resource, metric)
        text = f"SELECT value FROM state_view WHERE resource = '{resource}' AND metric = '{metric}'"
        assert one == views.current_value_sql(spark, text)
        rows.append((resource, metric, one))
    return spark.createDataFrame(rows, "resource string, metric string, value double")


@query(
    "raised_rules",
    with_sql(
        f"""
    SELECT rule_id, resource, metric, value FROM (
      SELECT 'hot' AS rule_id, s.* FROM ({LATEST_SQL}) s WHERE metric = 'click.value' AND value > 50
      UNION ALL SELECT 'none', s.* FROM ({LATEST_SQL}) s WHERE metric = 'click.value' AND value > 1e9
      UNION ALL SELECT 'low', s.* FROM ({LATEST_SQL}) s WHERE resource = 'server3' AND value <= 60)"""
    ),
)
def raised_rules(spark, sf_dir):
    """Conditions asked of the newest values; those that hold anywhere hand on what meets them."""
    state = views.latest(metrics(spark, sf_dir))
    conditions = {
        "hot": "metric = 'click.value' AND value > 50",
        "none": "metric = 'click.value' AND value > 1e9",
        "low": "resource = 'server3' AND value <= 60",
    }
    found = spark.createDataFrame([], "rule_id string, resource string, metric string, value double")
    for name, text in conditions.items():
        if views.rule_holds(state, text):
            handed = views.run_rule(state, text, lambda rows, name=name: rows.select(F.lit(name).alias("rule_id"), "*"))
            found = found.unionByName(handed)
    return found


@query(
    "metric_lookup",
    with_sql(
        f"""
    SELECT s.resource, s.metric, s.value, s.ts FROM ({LATEST_SQL}) s
    JOIN (SELECT DISTINCT resource, metric FROM r) w
      ON s.resource = w.resource AND s.metric = w.metric"""
    ),
)
def metric_lookup(spark, sf_dir):
    wanted = thresholds(spark).select("resource", "metric").distinct()
    return lookup.select_metrics(views.latest(metrics(spark, sf_dir)), wanted).drop("seq")


@query(
    "state_rule_detect",
    with_sql(
        f"""
    SELECT r.rule_id, s.resource, s.metric, s.value, s.ts,
           {holds_sql('s.value', 'r.op', 'r.threshold')} AS detect
    FROM ({LATEST_SQL}) s JOIN r ON s.resource = r.resource AND s.metric = r.metric"""
    ),
)
def state_rule_detect(spark, sf_dir):
    judged = lookup.select_rules(views.latest(metrics(spark, sf_dir)), thresholds(spark))
    return judged.select("rule_id", "resource", "metric", "value", "ts", "detect")


ROLLUP_OUT = """
    SELECT window_start, window_end, resource, metric, cnt, round(mean, 6) AS mean, min, max,
           round(stddev, 6) AS stddev"""


@query("rollup", with_sql(f"{ROLLUP_OUT} FROM w", w=rollup_sql("6 hours")))
def rollup(spark, sf_dir):
    return rounded(views.rollup(metrics(spark, sf_dir), "6 hours"), "mean", "stddev")


@query(
    "recent_rollups",
    with_sql(
        f"""{ROLLUP_OUT} FROM w WHERE date_diff('second', window_start, TIMESTAMP '{AS_OF}') <= 172800
    ORDER BY window_start, resource, metric""",
        w=rollup_sql("1 hour"),
    ),
)
def recent_rollups(spark, sf_dir):
    kept = views.rollup(metrics(spark, sf_dir), "1 hour", minutes=2880, as_of=AS_OF)
    return views.sorted_rollups(rounded(kept, "mean", "stddev"))


@query(
    "newest_windows",
    with_sql(
        f"{ROLLUP_OUT} FROM w ORDER BY window_start DESC, resource, metric LIMIT 5", w=rollup_sql("1 minute")
    ),
)
def newest_windows(spark, sf_dir):
    found = views.newest_windows(views.rollup(metrics(spark, sf_dir)))
    return rounded(found, "mean", "stddev")


@query(
    "rollup_mean",
    with_sql(
        f"""
    SELECT resource, metric, sum(cnt)::BIGINT AS total_cnt,
           round(coalesce(sum(mean * cnt) / nullif(sum(cnt), 0), 0), 6) AS mean,
           min(age) AS min_age, max(age) AS max_age
    FROM (SELECT *, date_diff('second', window_start, TIMESTAMP '{AS_OF}') AS age FROM w)
    WHERE age <= 604800 GROUP BY resource, metric""",
        w=rollup_sql("1 hour"),
    ),
)
def rollup_mean(spark, sf_dir):
    hourly = views.rollup(metrics(spark, sf_dir), "1 hour")
    return rounded(lookup.rollup_mean(hourly, 7 * 24 * 60, as_of=AS_OF), "mean")


ROLLUP_RULES = [
    {"rule_id": "p1", "resource": "server1", "metric": "click.value", "summary": "mean", "op": ">", "threshold": 20.0},
    {"rule_id": "p2", "resource": "server1", "metric": "click.value", "summary": "max", "op": ">=", "threshold": 100.0},
    {"rule_id": "p3", "resource": "server2", "metric": "error.k", "summary": "cnt", "op": "<", "threshold": 10.0},
    {"rule_id": "p4", "resource": "server3", "metric": "view.k", "summary": "stddev", "op": ">", "threshold": 25.0},
    {"rule_id": "p5", "resource": "server4", "metric": "view.k", "summary": "min", "op": "=", "threshold": 0.0},
    {"rule_id": "p6", "resource": "server4", "metric": "view.k", "summary": "median", "op": ">", "threshold": 0.0},
]
ROLLUP_RULES_SQL = values_sql(
    ROLLUP_RULES,
    {
        "rule_id": "VARCHAR", "resource": "VARCHAR", "metric": "VARCHAR", "summary": "VARCHAR",
        "op": "VARCHAR", "threshold": "DOUBLE",
    },
)


def chosen_sql(row):
    picks = " ".join(f"WHEN '{s}' THEN {row}.{s}" for s in ("mean", "min", "max", "cnt", "stddev"))
    return f"(CASE p.summary {picks} END)"


@query(
    "rollup_window_detect",
    with_sql(
        f"""
    SELECT w.window_start, w.resource, w.metric, p.rule_id,
           {holds_sql(chosen_sql('w'), 'p.op', 'p.threshold')} AS detect
    FROM w JOIN p ON w.resource = p.resource AND w.metric = p.metric""",
        w=rollup_sql("6 hours"),
        p=ROLLUP_RULES_SQL,
    ),
)
def rollup_window_detect(spark, sf_dir):
    rolled = views.rollup(metrics(spark, sf_dir), "6 hours")
    judged = detect.detect_rollups(rolled, rule_rows(spark, ROLLUP_RULES))
    return judged.select("window_start", "resource", "metric", "rule_id", "detect")


@query(
    "rollup_rule_detect",
    with_sql(
        f"""
    SELECT p.rule_id, a.resource, a.metric, p.summary, a.cnt AS total_cnt, round(a.mean, 6) AS mean,
           a.min_age, a.max_age, {holds_sql(chosen_sql('a'), 'p.op', 'p.threshold')} AS detect
    FROM a JOIN p ON a.resource = p.resource AND a.metric = p.metric""",
        p=ROLLUP_RULES_SQL,
        a=f"""SELECT resource, metric, count(value) AS cnt, avg(value) AS mean, min(value) AS min,
                max(value) AS max, stddev_samp(value) AS stddev, min(age) AS min_age, max(age) AS max_age
              FROM (SELECT *, date_diff('second', {_bucket('1 hour')}, TIMESTAMP '{AS_OF}') AS age FROM m)
              WHERE age <= 604800 GROUP BY resource, metric""",
    ),
)
def rollup_rule_detect(spark, sf_dir):
    hourly = views.rollup(metrics(spark, sf_dir), "1 hour")
    judged = lookup.rollup_rules(hourly, rule_rows(spark, ROLLUP_RULES), 7 * 24 * 60, as_of=AS_OF)
    return rounded(judged, "mean")


@query(
    "last_in_window",
    with_sql(
        f"""
    SELECT {_bucket('1 hour')} AS window_start, {_bucket('1 hour')} + INTERVAL '1 hour' AS window_end,
           resource, metric, arg_max(value, row(ts, seq)) AS value
    FROM m GROUP BY ALL"""
    ),
)
def last_in_window(spark, sf_dir):
    return views.last_in_window(metrics(spark, sf_dir), "1 hour")


@query("totals", with_sql("SELECT count(*) AS rows, count(value) AS with_value FROM m"))
def totals(spark, sf_dir):
    return counts.totals(metrics(spark, sf_dir))


@query(
    "partition_rows",
    with_sql("SELECT resource, metric, CAST(1 AS BIGINT) AS partitions, count(*) AS cnt FROM m GROUP BY ALL"),
)
def partition_rows(spark, sf_dir):
    """In how many hash partitions each key lies, which has to be one, and its rows."""
    return counts.partitions_of_keys(metrics(spark, sf_dir), 16, "resource", "metric")


@query("user_avg", with_sql("SELECT metric, round(avg(value), 6) AS user_avg FROM m GROUP BY metric"))
def user_average(spark, sf_dir):
    return rounded(user_avg(metrics(spark, sf_dir), ["metric"], "value"), "user_avg")


# Windows


def sliding_sql(size, slide, steps, keys, where="TRUE", more=""):
    """Windows of `size` every `slide`; `steps` is how many can hold one row."""
    start = f"unnest([{_bucket(slide)} - i * INTERVAL '{slide}' for i in range({steps})])"
    return f"""
  SELECT window_start, window_start + INTERVAL '{size}' AS window_end, {keys}, count(*) AS cnt {more}
  FROM (SELECT *, {start} AS window_start FROM m WHERE {where})
  WHERE ts < window_start + INTERVAL '{size}' GROUP BY window_start, {keys}"""


@query("sliding_count", with_sql(sliding_sql("1 hour", "20 minutes", 3, "resource, metric", "value > 50")))
def sliding_count(spark, sf_dir):
    kept = metrics(spark, sf_dir).where("value > 50")
    return windows.sliding_sums(kept, "1 hour", "20 minutes", ["resource", "metric"])


@query(
    "window_alarm",
    with_sql(f"SELECT * FROM ({sliding_sql('6 hours', '2 hours', 3, 'resource', 'value > 80')}) WHERE cnt >= 3"),
)
def window_alarm(spark, sf_dir):
    return windows.window_alarms(
        metrics(spark, sf_dir), F.col("value") > 80, "6 hours", "2 hours", 3, ["resource"]
    )


@query(
    "window_join_filter",
    with_sql(
        f"""
    SELECT a.window_start, a.window_end, a.resource, a.cnt, m.seq, m.metric, m.value
    FROM m JOIN a ON m.resource = a.resource AND m.ts >= a.window_start AND m.ts < a.window_end
    WHERE m.metric = 'purchase.value' AND m.value > 20""",
        a=f"""SELECT * FROM ({sliding_sql('6 hours', '3 hours', 2, 'resource', "metric = 'error.k' AND value > 50")})
              WHERE cnt >= 2""",
    ),
)
def window_join_filter(spark, sf_dir):
    joined = windows.window_join(
        metrics(spark, sf_dir),
        raw_condition("metric = 'error.k' AND value > 50"),
        raw_condition("metric = 'purchase.value' AND value > 20"),
        "6 hours",
        "3 hours",
        2,
    )
    return joined.drop("ts", "name")


@query(
    "count_sum_window",
    with_sql(
        "SELECT window_start, window_end, metric, cnt, round(total, 6) AS total FROM ("
        + sliding_sql("7 seconds", "5 seconds", 2, "metric", more=", sum(value) AS total")
        + ")"
    ),
)
def count_sum_window(spark, sf_dir):
    summed = windows.sliding_sums(metrics(spark, sf_dir), "7 seconds", "5 seconds", ["metric"], "value")
    return rounded(summed, "total")


@query(
    "range_stats",
    with_sql(
        f"""
    SELECT resource, metric, count(value) AS cnt, min(value) AS min, max(value) AS max,
           round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev
    FROM m WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL '10 days' AND TIMESTAMP '{AS_OF}'
    GROUP BY resource, metric"""
    ),
)
def range_stats(spark, sf_dir):
    found = windows.range_stats(metrics(spark, sf_dir), "10 days", AS_OF)
    return rounded(found, "mean", "stddev")


TRAILING_SQL = """
    SELECT seq, resource, metric, ts, value, count(value) OVER w AS cnt, round(avg(value) OVER w, 6) AS mean,
           min(value) OVER w AS min, max(value) OVER w AS max, round({spread}, 6) AS stddev
    FROM {rows} WINDOW w AS (PARTITION BY resource, metric ORDER BY ts
                        RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)"""


@query("trailing_range", with_sql(TRAILING_SQL.format(rows="m", spread="stddev_pop(value) OVER w")))
def trailing_range(spark, sf_dir):
    found = windows.trailing_stats(metrics(spark, sf_dir).drop("name"), "6 hours")
    return rounded(found, "mean", "stddev")


# Some readings are no numbers, or infinite. DuckDB refuses deviations of such values, so
# the reference leaves the odd ones out and says by itself what a range with one shows.
SPECIAL_SQL = """
    SELECT seq, resource, metric, ts, count(*) OVER w AS cnt,
           CASE WHEN count(*) FILTER (WHERE value IS NULL) OVER w > 0 THEN 'odd' ELSE 'plain' END AS kind,
           CASE WHEN count(*) FILTER (WHERE value IS NULL) OVER w = 0 THEN round(avg(value) OVER w, 6) END AS mean,
           CASE WHEN count(*) FILTER (WHERE value IS NULL) OVER w = 0 THEN round(stddev_pop(value) OVER w, 6) END AS stddev
    FROM (SELECT * REPLACE (CASE WHEN seq % 1000 IN (7, 8, 9) THEN NULL ELSE value END AS value) FROM m)
    WINDOW w AS (PARTITION BY resource, metric ORDER BY ts
                 RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW)"""


@query("trailing_range_special", with_sql(SPECIAL_SQL))
def trailing_range_special(spark, sf_dir):
    turn = F.col("seq") % 1000
    odd = F.when(turn == 7, float("nan")).when(turn == 8, float("inf")).when(turn == 9, float("-inf"))
    rows = metrics(spark, sf_dir).drop("name").withColumn("value", F.coalesce(odd, "value"))
    found = windows.trailing_stats(rows, "2 hours")
    plain = ~F.isnan("stddev")
    return found.select(
        "seq", "resource", "metric", "ts", "cnt",
        F.when(plain, "plain").otherwise("odd").alias("kind"),
        F.when(plain, F.round("mean", 6)).alias("mean"),
        F.when(plain, F.round("stddev", 6)).alias("stddev"),
    )


# The level of every key jumps by 1e12 halfway. Sums of such whole numbers are exact; deviations
# are compared on a scale of logarithms, as their last digits depend on the order of adding.
STEP_SQL = """
    SELECT seq, resource, metric, ts, count(value) OVER w AS cnt, avg(value) OVER w AS mean,
           min(value) OVER w AS min, max(value) OVER w AS max, round(ln(1 + stddev_pop(value) OVER w), 2) AS stddev
    FROM (SELECT * REPLACE (round(value * 100) + CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 1e12::DOUBLE ELSE 0 END AS value)
          FROM m)
    WINDOW w AS (PARTITION BY resource, metric ORDER BY ts
                 RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)"""


@query("trailing_range_step", with_sql(STEP_SQL))
def trailing_range_step(spark, sf_dir):
    later = F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows = metrics(spark, sf_dir).drop("name")
    rows = rows.withColumn("value", F.round(F.col("value") * 100) + F.when(later, 1e12).otherwise(0.0))
    found = windows.trailing_stats(rows, "6 hours").drop("value")
    return found.withColumn("stddev", F.round(F.log(1 + F.col("stddev")), 2))


@query(
    "trailing_range_join",
    with_sql(
        """
    SELECT a.seq, a.resource, a.metric, a.cnt, b.seq AS other
    FROM (SELECT seq, resource, metric, ts, count(value) OVER (PARTITION BY resource, metric ORDER BY ts
            RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS cnt FROM m) a
    JOIN (SELECT ts, seq FROM m WHERE metric = 'click.value') b ON a.ts = b.ts"""
    ),
)
def trailing_range_join(spark, sf_dir):
    rows = metrics(spark, sf_dir).drop("name")
    others = rows.where("metric = 'click.value'").select("ts", F.col("seq").alias("other"))
    found = windows.trailing_stats(rows, "6 hours").join(others, "ts")
    return found.select("seq", "resource", "metric", "cnt", "other")


# Continuous alarms and composed rules


CONTINUOUS_ALARM_SQL = """
    SELECT 'continuous' AS alarm_type, c.rule_id, c.target_rule_id, true AS detect,
           CAST(s.streak AS BIGINT) AS occur_count, s.ts AS occur_timestamp, s.seq, s.metric, s.value,
           '{"rule":{"ruleId":"' || c.rule_id || '","targetRuleId":"' || c.target_rule_id || '","markCount":'
             || c.mark_count || '}}' AS payload
    FROM s JOIN c ON s.rule_id = c.target_rule_id WHERE s.streak >= c.mark_count"""


@query("continuous_alarm", with_sql(CONTINUOUS_ALARM_SQL, d=DETECT_SQL, s=STREAK_SQL, c=CONTINUOUS_SQL))
def continuous_alarm(spark, sf_dir):
    return continuous.continuous_alarms(detections(spark, sf_dir), rule_rows(spark, CONTINUOUS))


@query(
    "current_streak",
    with_sql(
        "SELECT rule_id, CAST(arg_max(streak, row(ts, seq)) AS BIGINT) AS streak FROM s GROUP BY rule_id",
        d=DETECT_SQL,
        s=STREAK_SQL,
    ),
)
def current_streak(spark, sf_dir):
    return continuous.current_streaks(detections(spark, sf_dir))


# Verdicts on tied rows: an hour's rows share their time, and four events a sequence.
TIED_DETECT_SQL = """
  SELECT date_trunc('hour', ts) AS ts, seq // 4 AS seq, metric, value, rule_id, detect FROM d"""


@query(
    "current_streak_ties",
    with_sql(
        """
    SELECT rule_id, CAST(count(*) FILTER (detect AND after_last) AS BIGINT) AS streak FROM (
      SELECT *, NOT bool_or(NOT detect) OVER (
        PARTITION BY rule_id ORDER BY ts DESC, seq DESC, metric DESC NULLS LAST, value DESC NULLS LAST, detect DESC
        ROWS UNBOUNDED PRECEDING) AS after_last FROM t) GROUP BY rule_id""",
        d=DETECT_SQL,
        t=TIED_DETECT_SQL,
    ),
)
def current_streak_ties(spark, sf_dir):
    """The run each rule is in, where rows of one time and sequence differ in metric and value only."""
    tied = detections(spark, sf_dir).withColumns({"ts": F.date_trunc("hour", "ts"), "seq": F.floor(F.col("seq") / 4)})
    return continuous.current_streaks(tied)


LEAVES = [
    {"leaf_id": "v1", "resource": "server1", "metric": "click.value", "op": ">", "threshold": 0.0},
    {"leaf_id": "v2", "resource": "server2", "metric": "error.k", "op": "<", "threshold": 0.0},
    {"leaf_id": "v3", "resource": "server77", "metric": "error.k", "op": ">", "threshold": 0.0},
    {"leaf_id": "v4", "resource": "server77", "metric": "error.k", "op": ">", "threshold": 80.0, "value": 90.0},
    {"leaf_id": "v5", "resource": "server3", "metric": "view.k", "op": "~", "threshold": 1.0},
    {"leaf_id": "v6", "resource": "server3", "metric": "view.k", "op": "<=", "threshold": 99.0},
]
LEAF_COLUMNS = {
    "leaf_id": "VARCHAR", "resource": "VARCHAR", "metric": "VARCHAR", "op": "VARCHAR",
    "threshold": "DOUBLE", "value": "DOUBLE", "target_rule_id": "VARCHAR", "mark_count": "BIGINT",
    "agg": "VARCHAR", "span": "BIGINT",
}
_leaf = cep.Leaf
COMPOSED = [
    _leaf("v1") & _leaf("v6"),
    _leaf("v1") & _leaf("v2") | _leaf("v4"),
    _leaf("v1") | _leaf("v3"),
    _leaf("v2") & _leaf("v3"),
    (_leaf("v1") | _leaf("v2")) & (_leaf("v4") | _leaf("v6")),
    _leaf("v6") | _leaf("v5"),
]


def composed_sql(rules, leaves, group=""):
    """Composed rules written out by hand over leaf results `x` (leaf_id, result).

    `rules` maps an id to its condition; a rule with a missing leaf is missing.
    """
    columns = ", ".join(f"bool_or(result) FILTER (WHERE leaf_id = '{n}') AS {n}" for n in leaves)
    parts = []
    for name, condition in rules.items():
        used = [n for n in leaves if re.search(rf"\b{n}\b", condition)]
        missing = " OR ".join(f"{n} IS NULL" for n in used)
        parts.append(f"SELECT {group}'{name}' AS rule_id, CASE WHEN {missing} THEN NULL ELSE ({condition}) END AS result FROM p")
    by = f"GROUP BY {group.rstrip(', ')}" if group else ""
    return f", p AS (SELECT {group}{columns} FROM x {by}) " + " UNION ALL ".join(parts)


COMPOSED_SQL = {
    "v1:v6": "v1 AND v6",
    "v1:v2:v4": "(v1 AND v2) OR v4",
    "v1:v3": "v1 OR v3",
    "v2:v3": "v2 AND v3",
    "v1:v2:v4:v6": "(v1 OR v2) AND (v4 OR v6)",
    "v6:v5": "v6 OR v5",
}


@query(
    "compound_rule",
    with_sql(
        composed_sql(COMPOSED_SQL, ["v1", "v2", "v3", "v4", "v5", "v6"]),
        v=values_sql(LEAVES, LEAF_COLUMNS),
        x=f"""SELECT v.leaf_id,
                {holds_sql('coalesce(v.value, s.value)', 'v.op', 'v.threshold', 'NULL')} AS result
              FROM v LEFT JOIN ({LATEST_SQL}) s ON v.resource = s.resource AND v.metric = s.metric""",
    ),
)
def compound_rule(spark, sf_dir):
    leaves = cep.leaf_frame(spark, LEAVES)
    results = cep.value_leaves(leaves, metrics(spark, sf_dir))
    return cep.evaluate(cep.node_frame(spark, *COMPOSED), results)


V1, V2, V3, V4, V6 = (_leaf(n) for n in ("v1", "v2", "v3", "v4", "v6"))
DEEP = {
    "or-top": (((((V1 & V6) | V2) & V4) | V2) & V6) | V2,
    "and-top": (((((V1 | V2) & V6) | V4) & V1) | V2) & V6,
    "missing": (((((V1 & V6) | V2) & V4) | V3) & V6) | V1,
    "both-sides": ((((V1 & V2) | (V4 & V6)) & V1) | (V2 & (V4 | (V1 & V2)))) & (V6 | V2),
}
DEEP_SQL = {
    "or-top": "(((((v1 AND v6) OR v2) AND v4) OR v2) AND v6) OR v2",
    "and-top": "(((((v1 OR v2) AND v6) OR v4) AND v1) OR v2) AND v6",
    "missing": "(((((v1 AND v6) OR v2) AND v4) OR v3) AND v6) OR v1",
    "both-sides": "((((v1 AND v2) OR (v4 AND v6)) AND v1) OR (v2 AND (v4 OR (v1 AND v2)))) AND (v6 OR v2)",
}


@query(
    "compound_deep",
    with_sql(
        composed_sql(DEEP_SQL, ["v1", "v2", "v3", "v4", "v6"]),
        v=values_sql(LEAVES, LEAF_COLUMNS),
        x=f"""SELECT v.leaf_id,
                {holds_sql('coalesce(v.value, s.value)', 'v.op', 'v.threshold', 'NULL')} AS result
              FROM v LEFT JOIN ({LATEST_SQL}) s ON v.resource = s.resource AND v.metric = s.metric""",
    ),
)
def compound_deep(spark, sf_dir):
    """Rules of up to six levels over the latest values, their nodes read from a table."""
    path = run_dir(spark, "nodes")
    cep.node_frame(spark, *DEEP.items()).write.parquet(path)
    results = cep.value_leaves(cep.leaf_frame(spark, LEAVES), metrics(spark, sf_dir))
    return cep.evaluate(spark.read.parquet(path), results)


STREAK_LEAVES = [
    {"leaf_id": "k1", "target_rule_id": "t6", "mark_count": 2},
    {"leaf_id": "k2", "target_rule_id": "t1", "mark_count": 50},
    {"leaf_id": "k3", "target_rule_id": "none", "mark_count": 1},
]
RANGE_LEAVES = [
    {"leaf_id": "g1", "resource": "server1", "metric": "click.value", "agg": "mean", "op": ">", "threshold": 1.0, "span": 864000},
    {"leaf_id": "g2", "resource": "server2", "metric": "error.k", "agg": "stddev", "op": "<", "threshold": 1.0, "span": 432000},
    {"leaf_id": "g3", "resource": "server3", "metric": "view.k", "agg": "max", "op": ">=", "threshold": 10.0, "span": 1},
    {"leaf_id": "g4", "resource": "server3", "metric": "view.k", "agg": "min", "op": ">=", "threshold": 0.0, "span": 86400},
]
ALARM_LEAVES = [{"leaf_id": "a1", "target_rule_id": "t6"}, {"leaf_id": "a2", "target_rule_id": "none"}]
ALARM_VALUE_LEAVES = [
    {"leaf_id": "b1", "target_rule_id": "t4", "op": "<", "threshold": 2.0},
    {"leaf_id": "b2", "target_rule_id": "none", "op": "=", "threshold": 0.0},
]
MIXED = [
    _leaf("k1") & _leaf("g1"),
    _leaf("k2") | _leaf("a1"),
    _leaf("k3") | _leaf("g2") | _leaf("a2"),
    _leaf("b1") & _leaf("g4"),
    _leaf("b1") | _leaf("b2"),
    _leaf("g3") | _leaf("g4"),
]


MIXED_SQL = {
    "k1:g1": "k1 AND g1",
    "k2:a1": "k2 OR a1",
    "k3:g2:a2": "k3 OR g2 OR a2",
    "b1:g4": "b1 AND g4",
    "b1:b2": "b1 OR b2",
    "g3:g4": "g3 OR g4",
}


@query(
    "compound_mixed",
    with_sql(
        composed_sql(MIXED_SQL, ["k1", "k2", "k3", "g1", "g2", "g3", "g4", "a1", "a2", "b1", "b2"]),
        d=DETECT_SQL,
        s=STREAK_SQL,
        k=values_sql(STREAK_LEAVES, LEAF_COLUMNS),
        g=values_sql(RANGE_LEAVES, LEAF_COLUMNS),
        a=values_sql(ALARM_LEAVES, LEAF_COLUMNS),
        b=values_sql(ALARM_VALUE_LEAVES, LEAF_COLUMNS),
        n="""SELECT rule_id, arg_max(streak, row(ts, seq)) AS streak, arg_max(detect, row(ts, seq)) AS detect
             FROM s GROUP BY rule_id""",
        h=f"""SELECT g.leaf_id, g.op, g.threshold, CASE g.agg WHEN 'min' THEN min(m.value)
                WHEN 'max' THEN max(m.value) WHEN 'mean' THEN avg(m.value)
                WHEN 'stddev' THEN stddev_pop(m.value) END AS value
              FROM g LEFT JOIN m ON g.resource = m.resource AND g.metric = m.metric
                AND m.ts BETWEEN TIMESTAMP '{AS_OF}' - to_seconds(g.span) AND TIMESTAMP '{AS_OF}'
              GROUP BY g.leaf_id, g.op, g.threshold, g.agg""",
        x=f"""SELECT k.leaf_id, coalesce(n.streak, 0) >= k.mark_count AS result
              FROM k LEFT JOIN n ON k.target_rule_id = n.rule_id
              UNION ALL SELECT leaf_id, {holds_sql('value', 'op', 'threshold', 'NULL')} FROM h
              UNION ALL SELECT a.leaf_id, coalesce(n.detect, false)
              FROM a LEFT JOIN n ON a.target_rule_id = n.rule_id
              UNION ALL SELECT b.leaf_id,
                {holds_sql('CAST(n.detect AS INTEGER)', 'b.op', 'b.threshold', 'NULL')}
              FROM b LEFT JOIN n ON b.target_rule_id = n.rule_id""",
    ),
)
def compound_mixed(spark, sf_dir):
    found = detections(spark, sf_dir)
    alarms = detect.simple_alarms(found)
    results = (
        cep.streak_leaves(cep.leaf_frame(spark, STREAK_LEAVES), found)
        .unionByName(cep.range_leaves(cep.leaf_frame(spark, RANGE_LEAVES), metrics(spark, sf_dir), AS_OF))
        .unionByName(cep.alarm_leaves(cep.leaf_frame(spark, ALARM_LEAVES), alarms))
        .unionByName(cep.alarm_value_leaves(cep.leaf_frame(spark, ALARM_VALUE_LEAVES), alarms))
    )
    return cep.evaluate(cep.node_frame(spark, *MIXED), results)


STEP_LEAVES = [
    {"leaf_id": "w1", "resource": "server1", "metric": "click.value", "op": ">", "threshold": 10.0},
    {"leaf_id": "w2", "resource": "server1", "metric": "error.k", "op": ">", "threshold": 30.0},
    {"leaf_id": "w3", "resource": "server1", "metric": "view.k", "op": "<", "threshold": 60.0},
]
STEP_RULES = [("both", _leaf("w1") & _leaf("w2")), ("mix", _leaf("w1") & _leaf("w2") | _leaf("w3"))]


@query(
    "compound_window",
    with_sql(
        """
    SELECT window_start, window_start + INTERVAL '24 hours' AS window_end, rule_id, count(*) AS cnt
    FROM (SELECT *, unnest([step - i * INTERVAL '6 hours' for i in range(4)]) AS window_start FROM y)
    GROUP BY window_start, rule_id HAVING count(*) >= 2""",
        v=values_sql(STEP_LEAVES, LEAF_COLUMNS),
        z=f"""SELECT {_bucket('6 hours')} AS step, resource, metric, arg_max(value, row(ts, seq)) AS value
              FROM m GROUP BY ALL""",
        x=f"""SELECT z.step, v.leaf_id, {holds_sql('z.value', 'v.op', 'v.threshold', 'NULL')} AS result
              FROM v JOIN z ON v.resource = z.resource AND v.metric = z.metric""",
        p="""SELECT step, bool_or(result) FILTER (WHERE leaf_id = 'w1') AS w1,
               bool_or(result) FILTER (WHERE leaf_id = 'w2') AS w2, bool_or(result) FILTER (WHERE leaf_id = 'w3') AS w3
             FROM x GROUP BY step""",
        y="""SELECT step, 'both' AS rule_id FROM p WHERE w1 AND w2
             UNION ALL SELECT step, 'mix' FROM p
             WHERE w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL AND ((w1 AND w2) OR w3)""",
    ),
)
def compound_window(spark, sf_dir):
    return cep.composed_windows(
        metrics(spark, sf_dir),
        cep.leaf_frame(spark, STEP_LEAVES),
        cep.node_frame(spark, *STEP_RULES),
        "24 hours",
        "6 hours",
        2,
    )


# Progress of streaming queries


@query(
    "progress_dedup",
    f"""
    WITH e AS ({PROGRESS_SQL})
    SELECT query, batch_id, ts, start_offset FROM (
      SELECT *, lag(start_offset) OVER (PARTITION BY query ORDER BY ts, batch_id) AS before FROM e)
    WHERE start_offset IS DISTINCT FROM before""",
)
def progress_dedup(spark, sf_dir):
    return ops.changes_only(progress(spark, sf_dir))


@query(
    "offset_as_of",
    f"""
    WITH e AS ({PROGRESS_SQL}),
    pairs AS (SELECT query, ts AS from_ts, start_offset,
                lead(ts) OVER (PARTITION BY query ORDER BY ts, batch_id) AS to_ts,
                row_number() OVER (PARTITION BY query ORDER BY ts, batch_id) AS n FROM e),
    q AS (SELECT query, ts + INTERVAL '30 minutes' AS ts, batch_id AS request FROM e
          UNION ALL SELECT query, TIMESTAMP '2023-12-31', -1 FROM (SELECT DISTINCT query FROM e))
    SELECT q.query, q.ts, q.request, p.start_offset
    FROM q LEFT JOIN pairs p ON p.query = q.query AND q.ts <= p.to_ts AND (q.ts > p.from_ts OR p.n = 1)""",
)
def offset_as_of(spark, sf_dir):
    entries = progress(spark, sf_dir)
    asked = entries.select(
        "query", (F.col("ts") + F.expr("interval 30 minutes")).alias("ts"), F.col("batch_id").alias("request")
    )
    before = entries.groupBy("query").agg(
        F.lit("2023-12-31").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("request")
    )
    return ops.offsets_as_of(entries, asked.unionByName(before))


@query(
    "last_offset",
    f"""
    WITH e AS ({PROGRESS_SQL})
    SELECT query, arg_max(start_offset, row(ts, batch_id)) AS start_offset FROM e GROUP BY query""",
)
def last_offset(spark, sf_dir):
    return ops.last_offset(progress(spark, sf_dir))


@query("offset_history", f"SELECT query, date_trunc('milliseconds', ts) AS ts, start_offset FROM ({PROGRESS_SQL})")
def offset_history(spark, sf_dir):
    """The offsets of each query written as history text and read back."""
    entries, found = progress(spark, sf_dir), None
    for name in ("q0", "q1", "q2"):
        lines = entries.where(F.col("query") == name).select(ops.history_line().alias("value"))
        own = ops.parse_history(lines, name).select("query", "ts", "start_offset")
        found = own if found is None else found.unionByName(own)
    return plain_times(found, "ts")


@query(
    "batches_since",
    f"""
    WITH e AS ({PROGRESS_SQL})
    SELECT e.* FROM e JOIN (SELECT query, min(batch_id) AS start FROM e
                            WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY query) f
      ON e.query = f.query AND e.batch_id >= f.start""",
)
def batches_since(spark, sf_dir):
    return ops.batches_since(progress(spark, sf_dir), "2024-01-20 00:00:00")


# Streams, each run to the end of the events


def _finish(streaming_query):
    streaming_query.awaitTermination()


def stream_metrics(spark, sf_dir):
    return given.metrics_of(given.event_stream(spark, sf_dir))


def _detect_stream(spark, sf_dir, base):
    alarms = f"{base}/alarms"
    _finish(
        live.start_detection(
            stream_metrics(spark, sf_dir),
            lambda: thresholds(spark),
            alarms,
            f"{base}/checkpoint",
            available_now=True,
        )
    )
    return alarms


@query(
    "stream_detect",
    with_sql("SELECT rule_id, detect, CAST(detect AS INTEGER) AS occur_count, ts AS occur_timestamp, seq FROM d", d=DETECT_SQL),
)
def stream_detect(spark, sf_dir):
    alarms = _detect_stream(spark, sf_dir, run_dir(spark, "detect"))
    found = read_batches(spark, alarms, live.ALARMS)
    found = found.select("rule_id", "detect", F.col("occur_count").cast("int").alias("occur_count"), "occur_timestamp", "seq")
    return plain_times(found, "occur_timestamp")


@query("stream_continuous", ORACLES["continuous_alarm"])
def stream_continuous(spark, sf_dir):
    """Detections are written by one stream and watched by the next."""
    base = run_dir(spark, "continuous")
    alarms = _detect_stream(spark, sf_dir, base)
    _finish(
        streaks.start_continuous_alarms(
            batch_stream(spark, alarms, live.ALARMS),
            lambda: rule_rows(spark, CONTINUOUS),
            f"{base}/continuous",
            f"{base}/checkpoint_continuous",
            available_now=True,
        )
    )
    found = read_batches(spark, f"{base}/continuous", live.ALARMS).drop("batch_id")
    return plain_times(found, "occur_timestamp")


CHAINED = [
    {"rule_id": "cc1", "target_rule_id": "c1", "mark_count": 2},
    {"rule_id": "cc2", "target_rule_id": "c4", "mark_count": 1},
]
CHAINED_SQL = values_sql(
    CHAINED, {"rule_id": "VARCHAR", "target_rule_id": "VARCHAR", "mark_count": "BIGINT"}
)


@query(
    "stream_chained",
    with_sql(
        CONTINUOUS_ALARM_SQL.replace("FROM s JOIN", "FROM s2 s JOIN"),
        d=DETECT_SQL,
        s=STREAK_SQL,
        c1=CONTINUOUS_SQL,
        d2="""SELECT s.ts, s.seq, s.metric, s.value, c1.rule_id, true AS detect
              FROM s JOIN c1 ON s.rule_id = c1.target_rule_id WHERE s.streak >= c1.mark_count""",
        s2=STREAK_SQL.replace("FROM d)", "FROM d2)"),
        c=CHAINED_SQL,
    ),
)
def stream_chained(spark, sf_dir):
    """Continuous rules on the alarms of continuous rules: three streams in a row."""
    base = run_dir(spark, "chained")
    path = _detect_stream(spark, sf_dir, base)
    for n, rules in enumerate((CONTINUOUS, CHAINED)):
        _finish(
            streaks.start_continuous_alarms(
                batch_stream(spark, path, live.ALARMS),
                lambda rules=rules: rule_rows(spark, rules),
                f"{base}/hop{n}",
                f"{base}/checkpoint_hop{n}",
                available_now=True,
            )
        )
        path = f"{base}/hop{n}"
    return plain_times(read_batches(spark, path, live.ALARMS).drop("batch_id"), "occur_timestamp")


NAMED_CONTINUOUS = [
    {"rule_id": "nc1", "target_rule_id": "n1", "mark_count": 1},
    {"rule_id": "nc2", "target_rule_id": "n2", "mark_count": 2},
]


def event_files(spark, sf_dir, base, pieces=4):
    """The events as a stream of several files in the order of their times, one a micro-batch."""
    events = given.table(spark, sf_dir, "events")
    first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    number = F.least(F.floor((at - first) * pieces / F.lit(max(1, last - first))), F.lit(pieces - 1))
    for n in range(pieces):
        events.where(number == n).coalesce(1).write.mode("append").parquet(f"{base}/events")
    files = spark.readStream.schema(given.SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
    return files.parquet(f"{base}/events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_continuous_batches",
    with_sql(
        CONTINUOUS_ALARM_SQL,
        n=values_sql(
            [{**r, "name": r["metric"]} for r in NAME_RULES],
            {"rule_id": "VARCHAR", "name": "VARCHAR", "op": "VARCHAR", "threshold": "DOUBLE"},
        ),
        d=f"""SELECT m.ts, m.seq, m.metric, m.value, n.rule_id, {holds_sql('m.value', 'n.op', 'n.threshold')} AS detect
              FROM m JOIN n ON m.name = n.name""",
        s=STREAK_SQL,
        c=values_sql(NAMED_CONTINUOUS, {"rule_id": "VARCHAR", "target_rule_id": "VARCHAR", "mark_count": "BIGINT"}),
    ),
)
def stream_continuous_batches(spark, sf_dir):
    """Runs over four micro-batches, on rules under which both fields of an event share its place."""
    base = run_dir(spark, "continuous-batches")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    rules = rule_rows(spark, NAME_RULES).withColumnRenamed("metric", "name")
    found = detect.detect(rows, rules, keys=("name",)).withColumnRenamed("ts", "occur_timestamp")
    _finish(
        streaks.start_continuous_alarms(
            found, lambda: rule_rows(spark, NAMED_CONTINUOUS), f"{base}/alarms", f"{base}/checkpoint", available_now=True
        )
    )
    alarms = read_batches(spark, f"{base}/alarms", live.ALARMS).drop("batch_id")
    return plain_times(alarms, "occur_timestamp")


@query("stream_state_view_batches", ORACLES["state_view"])
def stream_state_view_batches(spark, sf_dir):
    """The view over four micro-batches, folded after every second one."""
    base = run_dir(spark, "state-batches")
    view = live.state_table(spark, f"{base}/view")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    _finish(live.start_state_view(rows, view, f"{base}/checkpoint", compact_every=2, available_now=True))
    return plain_times(view.read(), "ts")


@query("stream_rollup_batches", ORACLES["rollup"])
def stream_rollup_batches(spark, sf_dir):
    """The same for rollups, whose windows reach over the ends of micro-batches."""
    base = run_dir(spark, "rollup-batches")
    view = live.rollup_table(spark, f"{base}/view")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    _finish(live.start_rollup_view(rows, view, f"{base}/checkpoint", "6 hours", compact_every=2, available_now=True))
    return rounded(plain_times(view.read().drop("m2"), "window_start", "window_end"), "mean", "stddev")


@query("stream_state_view", ORACLES["state_view"])
def stream_state_view(spark, sf_dir):
    base = run_dir(spark, "state")
    view = live.state_table(spark, f"{base}/view")
    _finish(
        live.start_state_view(
            stream_metrics(spark, sf_dir), view, f"{base}/checkpoint", available_now=True
        )
    )
    return plain_times(view.read(), "ts")


@query("stream_rollup", ORACLES["rollup"])
def stream_rollup(spark, sf_dir):
    base = run_dir(spark, "rollup")
    view = live.rollup_table(spark, f"{base}/view")
    _finish(
        live.start_rollup_view(
            stream_metrics(spark, sf_dir), view, f"{base}/checkpoint", "6 hours", available_now=True
        )
    )
    return rounded(plain_times(view.read().drop("m2"), "window_start", "window_end"), "mean", "stddev")


@query("stream_rule_changes", f"WITH changes AS ({CHANGES_SQL}) {CURRENT_SQL}")
def stream_rule_changes(spark, sf_dir):
    """Rules in force out of a stream of changes in four micro-batches, removed ones left out."""
    base = run_dir(spark, "rules")
    view = live.rule_change_table(spark, f"{base}/view")
    changes = given.rule_changes_of(event_files(spark, sf_dir, base))
    _finish(live.start_rule_changes(changes, view, f"{base}/checkpoint", available_now=True))
    return plain_times(current_rules(view.read()), "updated_at")


@query(
    "rule_json",
    f"""
    WITH changes AS ({CHANGES_SQL})
    SELECT resource || ':' || metric || ':' || seq AS rule_id, resource, metric, op, threshold FROM changes
    WHERE seq % 5 <> 0
    UNION ALL SELECT resource || ':' || metric, resource, metric, '>', threshold FROM changes WHERE seq % 5 = 0""",
)
def rule_json(spark, sf_dir):
    """Rules out of JSON texts; every fifth names neither its id nor its comparison."""
    changes = given.rule_changes(spark, sf_dir)
    named = F.col("seq") % 5 != 0
    body = F.struct(
        F.when(named, F.concat_ws(":", "resource", "metric", F.col("seq").cast("string"))).alias("id"),
        "resource",
        "metric",
        F.col("threshold").alias("value"),
        F.when(named, F.col("op")).alias("op"),
    )
    path = run_dir(spark, "rule-json")
    changes.select(F.to_json(body).alias("value")).write.parquet(path)
    return load_rules(spark, path, json_column="value")


@query(
    "stream_verdicts",
    with_sql(
        """
    SELECT rule_id, CAST(detect AS INTEGER) AS detect, resource, metric AS event, value,
           concat_ws(' ', metric, op, CAST(CAST(threshold AS DECIMAL(10, 1)) AS VARCHAR)) AS filter
    FROM d""",
        d=DETECT_SQL,
    ),
)
def stream_verdicts(spark, sf_dir):
    """Every rule's verdict on every row, four micro-batches long."""
    base = run_dir(spark, "verdicts")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    _finish(live.start_rule_verdicts(rows, lambda: thresholds(spark), f"{base}/out", f"{base}/checkpoint", available_now=True))
    declared = "rule_id string, detect int, resource string, event string, value double, filter string"
    return read_batches(spark, f"{base}/out", declared).drop("batch_id")


CHANGED_AT = 2


@query(
    "stream_changed_rules",
    with_sql(
        f"""
    SELECT rule_id, seq, detect FROM (
      SELECT m.seq, {holds_sql('m.value', "'>'", 'CASE WHEN b.n < 2 THEN 50 ELSE 90 END')} AS detect, 'changed' AS rule_id
      FROM m JOIN b ON m.seq = b.event_id WHERE m.resource = 'server1' AND m.metric = 'click.value')""",
        b="""SELECT event_id, least(3, (epoch_us(ts) - f) * 4 // greatest(1, l - f)) AS n
             FROM events, (SELECT min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM events)""",
    ),
)
def stream_changed_rules(spark, sf_dir):
    """A rule that changes while the stream runs: from the third micro-batch on."""
    base = run_dir(spark, "changed")
    rows = given.metrics_of(event_files(spark, sf_dir, base))

    class Rules:
        """Rules that change with a batch, not with how often they are read."""

        def of_batch(self, batch_id):
            limit = 50.0 if batch_id < CHANGED_AT else 90.0
            return rule_rows(spark, [{"rule_id": "changed", "resource": "server1", "metric": "click.value", "op": ">", "threshold": limit}])

    _finish(live.start_detection(rows, Rules(), f"{base}/alarms", f"{base}/checkpoint", available_now=True))
    return read_batches(spark, f"{base}/alarms", live.ALARMS).select("rule_id", "seq", "detect")


@query(
    "stream_counts",
    with_sql(
        """
    SELECT metric, CAST(count_if(NOT detect) AS BIGINT) AS not_detected,
           CAST(count_if(detect) AS BIGINT) AS detected, count(*) AS batch_count
    FROM d GROUP BY metric""",
        d=DETECT_SQL,
    ),
)
def stream_counts(spark, sf_dir):
    base = run_dir(spark, "counts")
    _finish(
        live.start_counts(
            stream_metrics(spark, sf_dir),
            lambda: thresholds(spark),
            f"{base}/counts",
            f"{base}/checkpoint",
            available_now=True,
        )
    )
    found = read_batches(spark, f"{base}/counts", live.COUNTS)
    return found.groupBy("metric").agg(
        *[F.sum(c).alias(c) for c in ("not_detected", "detected", "batch_count")]
    )


def _table_of(df, spark, base):
    _finish(live.start_table(df, f"{base}/out", f"{base}/checkpoint", available_now=True))
    found = spark.read.parquet(f"{base}/out")
    return plain_times(found, "window_start", "window_end")


@query(
    "stream_last_in_window",
    with_sql(
        f"""
    SELECT * FROM (
    SELECT {_bucket('1 hour')} AS window_start, {_bucket('1 hour')} + INTERVAL '1 hour' AS window_end,
           resource, metric, arg_max(value, row(ts, seq)) AS value
    FROM m GROUP BY ALL)
    WHERE window_end <= (SELECT max(ts) FROM m) - INTERVAL '20 seconds'"""
    ),
)
def stream_last_in_window(spark, sf_dir):
    """Windows the watermark has passed at the end of the stream."""
    closed = live.last_in_window(stream_metrics(spark, sf_dir), "1 hour", "20 seconds")
    return _table_of(closed, spark, run_dir(spark, "last"))


@query(
    "stream_window_alarm",
    with_sql(
        f"""
    SELECT * FROM ({sliding_sql('6 hours', '2 hours', 3, 'resource', 'value > 80')})
    WHERE cnt >= 3 AND window_end <= (SELECT max(ts) FROM m WHERE value > 80) - INTERVAL '6 hours'"""
    ),
)
def stream_window_alarm(spark, sf_dir):
    counted = live.window_alarms(
        stream_metrics(spark, sf_dir), F.col("value") > 80, "6 hours", "2 hours", 3, ["resource"]
    )
    return _table_of(counted, spark, run_dir(spark, "window"))


# Registers its queries with those above.
from pulsewatch.plans import rule_queries  # noqa: E402, F401
