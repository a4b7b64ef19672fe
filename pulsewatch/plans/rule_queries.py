"""Registered queries on large rule tables, on rules over time, and on keyed state."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from pulsewatch.functions.averages import user_avg_sql
from pulsewatch.functions.predicates import raw_condition
from pulsewatch.functions.times import micros
from pulsewatch.operators import cep, detect, history, intervals, keywords
from pulsewatch.operators import progress as ops
from pulsewatch.plans import tables as given
from pulsewatch.plans.catalog import (
    CHANGES_SQL,
    CONTINUOUS,
    CONTINUOUS_ALARM_SQL,
    CONTINUOUS_SQL,
    DEEP,
    DEEP_SQL,
    DETECT_SQL,
    LEAF_COLUMNS,
    LEAVES,
    ORACLES,
    PROGRESS_SQL,
    STREAK_SQL,
    _finish,
    composed_sql,
    event_files,
    holds_sql,
    metrics,
    plain_times,
    query,
    rollup_sql,
    rule_rows,
    thresholds,
    values_sql,
    with_sql,
)
from pulsewatch.session import run_dir
from pulsewatch.sources import replay, sink
from pulsewatch.sources.files import place, put_once
from pulsewatch.sources.tables import read_batches
from pulsewatch.sources.versions import RuleVersions
from pulsewatch.streaming import composed, keyed, live

# Log rules out of the documents: a hundred pieces of each text, every eighth for all languages.
MANY_KEYWORDS_SQL = """
  SELECT 'k' || doc_id || ':' || i AS rule_id, CASE WHEN i % 8 <> 0 THEN lang END AS resource,
         CASE WHEN i = 99 THEN '=' ELSE 'like' END AS op,
         substring(text, CAST(1 + (i * 37) % greatest(1, length(text) - 12) AS INTEGER), CAST(12 + i % 9 AS INTEGER)) AS keyword
  FROM documents, (SELECT unnest(range(100)) AS i)"""


def many_keywords(spark, sf_dir):
    docs = given.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")

    def pieces(numbers, op):
        # Out of Python's strings, where a piece is not searched for from the start of its text.
        def run(batches):
            tails = pa.array([f":{i}" for i in numbers])
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    docs = batch.slice(at, 100)
                    doc = pa.array(np.repeat(np.arange(len(docs)), len(numbers)))
                    i = np.tile(np.arange(len(numbers)), len(docs))
                    ids = pc.binary_join_element_wise("k", docs.column(0).cast(pa.string()).take(doc), tails.take(pa.array(i)), "")
                    owns = docs.column(2).take(pc.if_else(pa.array(np.array(numbers)[i] % 8 != 0), doc, None))
                    words = []
                    for text in docs.column(1).to_pylist():
                        span = max(1, len(text) - 12) if text is not None else 0
                        words += [text[(p := n * 37 % span) : p + 12 + n % 9] for n in numbers] if span else [None] * len(numbers)
                    yield pa.RecordBatch.from_arrays([ids, owns, pa.array(words, pa.string())], names=["rule_id", "resource", "keyword"])
            batch = docs = None
            keywords.let_go()

        return docs.mapInArrow(run, "rule_id string, resource string, keyword string").withColumn("op", F.lit(op))

    return pieces(range(99), "like").unionByName(pieces([99], "=")).select("rule_id", "resource", "op", "keyword")


@query(
    "log_rule_many",
    f"""
    WITH l AS ({MANY_KEYWORDS_SQL}), hits AS (
      SELECT l.rule_id, d.doc_id FROM documents d JOIN l ON l.resource = d.lang AND l.op = 'like' AND contains(d.text, l.keyword)
      UNION ALL SELECT l.rule_id, d.doc_id FROM documents d JOIN l ON l.resource IS NULL AND l.op = 'like' AND contains(d.text, l.keyword)
      UNION ALL SELECT l.rule_id, d.doc_id FROM documents d JOIN l ON d.text = l.keyword AND l.op = '='
        AND (l.resource IS NULL OR l.resource = d.lang))
    SELECT rule_id, count(*) AS hits, min(doc_id) AS first_seq, CAST(sum(doc_id) AS BIGINT) AS seqs FROM hits GROUP BY rule_id""",
)
def log_rule_many(spark, sf_dir):
    """A hundred log rules a document against all documents, by the keyword index."""
    hits = keywords.detect_keywords(given.logs(spark, sf_dir), many_keywords(spark, sf_dir), totals="seq")
    # Few rules have several parts, so that adding them up before the shuffle would only hold them twice.
    found = hits.repartition("rule_id").groupBy("rule_id").agg(F.sum("hits").alias("hits"), F.min("first").alias("first_seq"), F.sum("total").alias("seqs"))
    return found


# Every event as a rule on one key, most of them for single values.
MANY_RULES_SQL = """
  SELECT 'i' || event_id AS rule_id, 'server1' AS resource, 'click.value' AS metric,
         CASE WHEN event_id % 1000 = 999 THEN '>=' WHEN event_id % 1000 = 998 THEN '<'
              WHEN event_id % 500 = 250 THEN '!=' ELSE '=' END AS op,
         CASE WHEN event_id % 1000 = 999 THEN value + 80 WHEN event_id % 1000 = 998 THEN value - 80 ELSE value END AS threshold,
         CASE WHEN event_id % 500 = 250 THEN 100000000 + event_id ELSE event_id END AS rule_order
  FROM events"""


def many_rules(spark, sf_dir):
    events, k = given.table(spark, sf_dir, "events"), F.col("event_id") % 1000
    high, low, other = k == 999, k == 998, F.col("event_id") % 500 == 250
    return events.select(
        F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("rule_id"),
        F.lit("server1").alias("resource"),
        F.lit("click.value").alias("metric"),
        F.when(high, ">=").when(low, "<").when(other, "!=").otherwise("=").alias("op"),
        F.when(high, F.col("value") + 80).when(low, F.col("value") - 80).otherwise(F.col("value")).alias("threshold"),
        F.when(other, 100000000 + F.col("event_id")).otherwise(F.col("event_id")).alias("rule_order"),
    )


INTERVALS_SQL = with_sql(
    f"""
    SELECT seq, resource, metric, value, coalesce(id, '') AS id, CAST(id IS NOT NULL AS INTEGER) AS chk FROM (
      SELECT m.seq, m.resource, m.metric, m.value, arg_min(o.rule_id, o.rule_order) AS id
      FROM m LEFT JOIN o ON m.resource = o.resource AND m.metric = o.metric
        AND {holds_sql('m.value', 'o.op', 'o.threshold')}
      GROUP BY m.seq, m.resource, m.metric, m.value)""",
    o=MANY_RULES_SQL,
)


@query("first_match_intervals", INTERVALS_SQL)
def first_match_intervals(spark, sf_dir):
    """A rule per event on one key: each row finds its first one by binary search."""
    found = intervals.first_match_intervals(metrics(spark, sf_dir), many_rules(spark, sf_dir))
    return found.select("seq", "resource", "metric", "value", "id", "chk")


@query("first_match_intervals_spread", INTERVALS_SQL)
def first_match_intervals_spread(spark, sf_dir):
    """The same with intervals too many to send to every task."""
    found = intervals.first_match_intervals(metrics(spark, sf_dir), many_rules(spark, sf_dir), spread=True)
    return found.select("seq", "resource", "metric", "value", "id", "chk")


@query(
    "any_rule_intervals",
    with_sql("SELECT DISTINCT ts, seq, resource, metric, value FROM d WHERE detect", d=DETECT_SQL),
)
def any_rule_intervals(spark, sf_dir):
    return intervals.any_match_intervals(metrics(spark, sf_dir), thresholds(spark)).drop("name")


@query(
    "detect_as_of",
    with_sql(
        f"""
    SELECT m.ts, m.seq, m.resource, m.metric, m.value, h.rule_id, h.op, h.threshold,
           {holds_sql('m.value', 'h.op', 'h.threshold')} AS detect
    FROM m JOIN h ON m.resource = h.resource AND m.metric = h.metric
      AND m.ts >= h.updated_at AND (h.until IS NULL OR m.ts < h.until)
    WHERE NOT h.deleted""",
        changes=CHANGES_SQL,
        h="""SELECT *, lead(updated_at) OVER (PARTITION BY rule_id ORDER BY updated_at, seq) AS until FROM changes""",
    ),
)
def detect_as_of(spark, sf_dir):
    """Every metric row against the rules that were in force at its time."""
    return history.detect_as_of(metrics(spark, sf_dir).drop("name"), given.rule_changes(spark, sf_dir))


DELAY = "6 hours"
FILE_ROWS = 250_000


def shuffled_event_files(spark, sf_dir, base, delay=DELAY, pieces=5):
    """The events in an order that is off by up to `delay`, in `pieces` micro-batches of equally many
    files, each of about `FILE_ROWS`."""
    events = given.table(spark, sf_dir, "events")
    late = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(micros(delay)))
    placed = events.withColumn("_at", late)
    first, last, rows = placed.agg(F.min("_at"), F.max("_at"), F.count("_at")).first()
    number = F.least(F.floor((F.col("_at") - first) * pieces / F.lit(max(1, last - first))), F.lit(pieces - 1))
    path, files = f"{base}/events", max(1, math.ceil(rows / pieces / FILE_ROWS))
    reader = spark.read.schema(given.SCHEMAS["events"])
    for n in range(pieces):
        part = placed.where(number == n).repartition(files, "event_id")
        part = part.sortWithinPartitions(F.xxhash64("event_id", F.lit(n))).drop("_at")
        part.write.mode("append").parquet(path)
        # Tasks without rows write no file, and a micro-batch takes a number of files.
        for _ in range(len(reader.parquet(path).inputFiles()), files * (n + 1)):
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(given.SCHEMAS["events"]).option("maxFilesPerTrigger", files)
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_continuous_state",
    with_sql(
        CONTINUOUS_ALARM_SQL
        + f" AND s.ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM d) - INTERVAL '{DELAY}'",
        d=DETECT_SQL,
        s=STREAK_SQL,
        c=CONTINUOUS_SQL,
    ),
)
def stream_continuous_state(spark, sf_dir):
    """Continuous alarms over events out of order, in five micro-batches: those the watermark has passed."""
    base = run_dir(spark, "continuous-state")
    rows = given.metrics_of(shuffled_event_files(spark, sf_dir, base))
    found = detect.detect(rows, thresholds(spark)).withColumnRenamed("ts", "occur_timestamp")
    _finish(
        keyed.start_continuous_state(
            found, lambda: rule_rows(spark, CONTINUOUS), f"{base}/alarms", f"{base}/checkpoint", DELAY, available_now=True
        )
    )
    return plain_times(read_batches(spark, f"{base}/alarms", live.ALARMS).drop("batch_id"), "occur_timestamp")


PINNED_AT = 1


@query(
    "stream_pinned_rules",
    with_sql(
        f"""
    SELECT 'pinned' AS rule_id, m.seq,
           {holds_sql('m.value', "'>'", f'CASE WHEN b.n <= {PINNED_AT} THEN 50 ELSE 90 END')} AS detect
    FROM m JOIN b ON m.seq = b.event_id WHERE m.resource = 'server1' AND m.metric = 'click.value'""",
        b="""SELECT event_id, least(3, (epoch_us(ts) - f) * 4 // greatest(1, l - f)) AS n
             FROM events, (SELECT min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM events)""",
    ),
)
def stream_pinned_rules(spark, sf_dir):
    """A query that dies in its second micro-batch and goes on after its rule has changed: that batch
    is judged by the rule it was begun with."""
    base = run_dir(spark, "pinned")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    rule = {"rule_id": "pinned", "resource": "server1", "metric": "click.value", "op": ">"}
    now = {"limit": 50.0}
    versions = RuleVersions(spark, f"{base}/rules", lambda: rule_rows(spark, [{**rule, "threshold": now["limit"]}]))
    rules = versions.of("detect")

    class Dies:
        """The rules of the query, in a process that ends right after a batch was given its version."""

        def of_batch(self, batch_id):
            found = rules.of_batch(batch_id)
            if batch_id == PINNED_AT:
                raise RuntimeError("the process ends here")
            return found

    def start(load):
        return live.start_detection(rows, load, f"{base}/alarms", f"{base}/checkpoint", available_now=True)

    first = start(Dies())
    try:
        _finish(first)
    except Exception:
        if "the process ends here" not in str(first.exception()):
            raise
    now["limit"] = 90.0
    _finish(start(rules))
    return read_batches(spark, f"{base}/alarms", live.ALARMS).select("rule_id", "seq", "detect")


COMPOSED_STREAM_SQL = composed_sql(DEEP_SQL, ["v1", "v2", "v3", "v4", "v6"], "n, ")


@query(
    "stream_composed",
    with_sql(
        COMPOSED_STREAM_SQL.replace("SELECT n, ", "SELECT CAST(n AS BIGINT) AS batch_id, ").replace(
            "p AS (SELECT CAST(n AS BIGINT) AS batch_id, ", "p AS (SELECT n, "
        ),
        v=values_sql(LEAVES, LEAF_COLUMNS),
        b="""SELECT event_id, least(3, (epoch_us(ts) - f) * 4 // greatest(1, l - f)) AS n
             FROM events, (SELECT min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM events)""",
        s="""SELECT a.n, m.resource, m.metric, arg_max(m.value, row(m.ts, m.seq)) AS value
             FROM (SELECT unnest(range(4)) AS n) a JOIN b ON b.n <= a.n JOIN m ON m.seq = b.event_id GROUP BY ALL""",
        x=f"""SELECT a.n, v.leaf_id, {holds_sql('coalesce(v.value, s.value)', 'v.op', 'v.threshold', 'NULL')} AS result
              FROM v CROSS JOIN (SELECT unnest(range(4)) AS n) a
              LEFT JOIN s ON s.n = a.n AND v.resource = s.resource AND v.metric = s.metric""",
    ),
)
def stream_composed(spark, sf_dir):
    """The verdict of every composed rule after each of four micro-batches, out of the changes alone."""
    base = run_dir(spark, "composed")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    nodes = cep.node_frame(spark, *DEEP.items())
    _finish(
        composed.start_composed(
            rows, cep.leaf_frame(spark, LEAVES), nodes, base, f"{base}/checkpoint", compact_every=2, available_now=True
        )
    )
    changes = read_batches(spark, f"{base}/changes", composed.CHANGES)
    after = spark.range(4).withColumnRenamed("id", "n").join(changes, F.col("batch_id") <= F.col("n"))
    last = after.groupBy("n", "rule_id").agg(F.max_by(F.struct("result"), "batch_id").alias("r"))
    return last.select(F.col("n").alias("batch_id"), "rule_id", "r.result")


@query(
    "stream_sink",
    with_sql(
        """SELECT rule_id, detect, CAST(detect AS BIGINT) AS occur_count, ts AS occur_timestamp, seq, metric, value FROM d""",
        d=DETECT_SQL,
    ),
)
def stream_sink(spark, sf_dir):
    """Alarms through the sink, with a task that fails when it has written its rows, and a query that goes on."""
    base = run_dir(spark, "sink")
    failed = f"{base}/failed"
    sink.register_sink(spark)

    def fails_once(batches):
        for batch in batches:
            yield batch
            system, path = place(failed)
            if batch.num_rows and put_once(system, path, b""):
                raise RuntimeError("the task ends here")

    rows = given.metrics_of(event_files(spark, sf_dir, base))
    found = live.as_alarms(detect.simple_alarms(detect.detect(rows, thresholds(spark))))
    alarms = found.mapInArrow(fails_once, found.schema)
    for _ in range(3):
        started = sink.start_sink(alarms, f"{base}/alarms", f"{base}/checkpoint", available_now=True)
        try:
            _finish(started)
            break
        except Exception:
            if "the task ends here" not in str(started.exception()):
                raise
    told = sink.read_committed(spark, f"{base}/alarms", live.ALARMS)
    return plain_times(told.select("rule_id", "detect", "occur_count", "occur_timestamp", "seq", "metric", "value"), "occur_timestamp")


LOG_COLUMNS = "event_id long, part int, user_id long, event_type string, value double"
REPLAY_AT = "2024-01-15 00:00:00"


@query(
    "stream_replay",
    f"""
    WITH e AS ({PROGRESS_SQL}),
    pairs AS (SELECT ts, start_offset, lead(ts) OVER (ORDER BY ts, batch_id) AS to_ts, row_number() OVER (ORDER BY ts, batch_id) AS n
              FROM e WHERE query = 'q1'),
    o AS (SELECT CAST(json_extract_string(start_offset, '$.metric."0"') AS BIGINT) AS first FROM pairs
          WHERE TIMESTAMP '{REPLAY_AT}' <= to_ts AND (TIMESTAMP '{REPLAY_AT}' > ts OR n = 1))
    SELECT event_id, CAST(user_id % 4 AS INTEGER) AS part, user_id, event_type, value, "offset" FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS "offset" FROM events)
    WHERE "offset" >= CASE WHEN user_id % 4 = 0 THEN (SELECT first FROM o) ELSE 0 END""",
)
def stream_replay(spark, sf_dir):
    """The events as a log of four partitions, replayed from the offset recorded for a time, in bounded batches."""
    base = run_dir(spark, "replay")
    events = given.table(spark, sf_dir, "events").withColumn("part", (F.col("user_id") % 4).cast("int"))
    columns = [c.split()[0] for c in LOG_COLUMNS.split(", ")]
    log = replay.write_log(events.select(*columns, "ts"), f"{base}/log", "part", ["ts", "event_id"])
    start = ops.offset_at(given.progress(spark, sf_dir), "q1", REPLAY_AT)
    most = max(4, events.count() // 5)
    rows = replay.stream_log(spark, log, LOG_COLUMNS, f"{base}/checkpoint", start, max_rows=most)
    started = live.start_table(rows, f"{base}/out", f"{base}/checkpoint")
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


WINDOW_LATE = "3 hours"


@query(
    "stream_window_join",
    ORACLES["window_join_filter"] + f" AND a.window_end <= (SELECT date_trunc('milliseconds', max(ts)) FROM m) - INTERVAL '{WINDOW_LATE}'",
)
def stream_window_join(spark, sf_dir):
    """Two streams joined on windows, over four micro-batches: the rows of closed windows."""
    base = run_dir(spark, "window-join")
    joined = live.window_join(
        given.metrics_of(event_files(spark, sf_dir, base)),
        raw_condition("metric = 'error.k' AND value > 50"),
        raw_condition("metric = 'purchase.value' AND value > 20"),
        "6 hours",
        "3 hours",
        2,
        late=WINDOW_LATE,
    )
    _finish(live.start_table(joined, f"{base}/out", f"{base}/checkpoint", available_now=True))
    found = spark.read.schema(joined.schema).parquet(f"{base}/out")
    return plain_times(found.drop("ts", "name"), "window_start", "window_end")


VIEW_FROM, VIEW_UNTIL = "2024-01-10 00:00:00", "2024-01-11 00:00:00"


@query(
    "rollup_mean_view",
    with_sql(
        f"""
    SELECT resource, metric, round(sum(cnt * mean) / sum(cnt), 6) AS mean, CAST(sum(cnt) AS BIGINT) AS cnt FROM u
    WHERE window_start BETWEEN TIMESTAMP '{VIEW_FROM}' AND TIMESTAMP '{VIEW_UNTIL}' AND cnt > 0 GROUP BY ALL""",
        u=rollup_sql("6 hours"),
    ),
)
def rollup_mean_view(spark, sf_dir):
    """Means over a day out of a streamed view that is divided by hours: only that day's are opened."""
    base = run_dir(spark, "rollup-hours")
    view = live.rollup_table(spark, f"{base}/view", layout="1 hour")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    _finish(live.start_rollup_view(rows, view, f"{base}/checkpoint", "6 hours", compact_every=2, available_now=True))
    day = view.read(between=(VIEW_FROM, VIEW_UNTIL)).where("cnt > 0")
    mean = F.sum(F.col("cnt") * F.col("mean")) / F.sum("cnt")
    found = day.groupBy("resource", "metric").agg(F.round(mean, 6).alias("mean"), F.sum("cnt").alias("cnt"))
    return found


@query("user_avg_sql", ORACLES["user_avg"])
def user_average_sql(spark, sf_dir):
    """The user-defined average in SQL text, no group of which has to fit a task."""
    metrics(spark, sf_dir).createOrReplaceTempView("metric_rows")
    found = user_avg_sql(spark, "metric_rows", "metric", "value")
    return found.withColumn("user_avg", F.round("user_avg", 6))


@query(
    "stream_update_counts",
    with_sql("SELECT metric, count(*) AS cnt, max(value) AS most FROM m GROUP BY metric"),
)
def stream_update_counts(spark, sf_dir):
    """A stateful count in update mode, over four micro-batches: each writes the groups it changed."""
    base = run_dir(spark, "update-counts")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    counted = rows.groupBy("metric").agg(F.count(F.lit(1)).alias("cnt"), F.max("value").alias("most"))
    started, table = live.start_upserts(counted, f"{base}/counts", ["metric"], f"{base}/checkpoint", available_now=True)
    _finish(started)
    return table.read().drop("batch_id")


@query("stream_processing_time", with_sql(DETECT_SQL.replace("m.ts, m.seq,", "m.seq,")))
def stream_processing_time(spark, sf_dir):
    """Detection on a processing-time trigger, until what there is has been worked off."""
    base = run_dir(spark, "processing-time")
    rows = given.metrics_of(event_files(spark, sf_dir, base))
    found = detect.detect(rows, thresholds(spark)).drop("ts", "name")
    started = live.start_table(found, f"{base}/out", f"{base}/checkpoint", every="100 milliseconds")
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    return spark.read.schema(found.schema).parquet(f"{base}/out")
