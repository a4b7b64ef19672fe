"""Streaming queries: detection with live rules, views, windows and counts.

Where a result merges from parts, micro-batches are worked out with the batch operators
and stored as partials. Such a query holds no state, counts late rows like any other,
and gives the same view as one batch over all rows. Windows that must close and be
emitted once use a watermark instead.
"""

from contextlib import contextmanager
from math import gcd

from pyspark.sql import functions as F

from pulsewatch import schema
from pulsewatch.functions.encode import encode_alarm
from pulsewatch.functions.moments import merge_moments, partial_moments, sample_stddev
from pulsewatch.functions.times import duration, micros, ordinal
from pulsewatch.operators import counts as counting
from pulsewatch.operators import detect as rule
from pulsewatch.operators.rulebook import newest_rows, rules_of_kind
from pulsewatch.operators.views import latest
from pulsewatch.sources.tables import COMPACT_EVERY, PartialTable, batch_folder, batch_stream, make_folder

KEYS = ("resource", "metric")

# One form for simple and continuous alarms, so that either can be watched by further rules.
# `metric` and `value` only complete the order of alarms that share time and sequence.
ALARMS = (
    "alarm_type string, rule_id string, target_rule_id string, detect boolean, occur_count long, "
    "occur_timestamp timestamp, seq long, metric string, value double, payload string"
)
ALARM_COLUMNS = tuple(c.split()[0] for c in ALARMS.split(", "))


def as_alarms(alarms):
    """Simple or continuous alarms in the one form they are stored in."""
    missing = {"target_rule_id": "string", "metric": "string", "value": "double"}
    full = alarms.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in alarms.columns})
    full = full.withColumn("occur_count", F.col("occur_count").cast("long"))
    return full.withColumn("occur_timestamp", F.col("occur_timestamp").cast("timestamp")).select(*ALARM_COLUMNS)


def _writer(df, checkpoint, name=None, mode="append", every=None, available_now=False):
    """A stream writer with its own checkpoint folder and trigger."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every) if every else writer


def per_batch(df, handle, checkpoint, **options):
    """Run `handle(batch, batch_id)` on every micro-batch."""
    return _writer(df, checkpoint, **options).foreachBatch(handle).start()


@contextmanager
def version(load_rules, batch_id=None):
    """One reading of the rules, for everything a micro-batch does with them.

    Rules of `RuleVersions` are those the batch was given when it was first tried.
    """
    pinned = getattr(load_rules, "of_batch", None)
    rules = (load_rules() if pinned is None or batch_id is None else pinned(batch_id)).persist()
    try:
        yield rules
    finally:
        rules.unpersist()


def start_detection(metrics, load_rules, alarms_path, checkpoint, **options):
    """Threshold alarms with rules that may change while the query runs.

    `load_rules()` is called once per micro-batch and its result used for all of it, so
    a change takes effect with the next batch and a batch never mixes two versions. Given
    `RuleVersions(...).of(name)`, a batch that is tried again is judged by the same version. Of a
    table of all kinds only threshold rules are judged here.
    """

    def handle(batch, batch_id):
        with version(load_rules, batch_id) as rules:
            found = rule.detect(batch, rules_of_kind(rules, "threshold"))
            batch_folder(as_alarms(rule.simple_alarms(found)), alarms_path, batch_id)

    return per_batch(metrics, handle, checkpoint, **options)


def start_rule_verdicts(metrics, load_rules, path, checkpoint, **options):
    """Every rule's verdict on every batch, with the rule's text and processing time."""

    def handle(batch, batch_id):
        with version(load_rules, batch_id) as rules:
            batch_folder(rule.evaluate_batch(batch, rules_of_kind(rules, "threshold")), path, batch_id)

    return per_batch(metrics, handle, checkpoint, **options)


def state_table(spark, path, value_keys=KEYS, ts="timestamp"):
    """The latest-value view as a table of partials."""
    columns = ", ".join(f"{k} string" for k in value_keys)
    return PartialTable(
        spark,
        path,
        f"{columns}, value double, ts {ts}, seq long",
        lambda partials: latest(partials, value_keys),
    )


def start_state_view(metrics, table, checkpoint, keys=KEYS, compact_every=COMPACT_EVERY, retention=None, **options):
    """Keep the latest value per key in `table`, folded after every `compact_every` batches.

    With `retention` (a duration) folding leaves out keys without a value in that time.
    """

    def handle(batch, batch_id):
        table.write(latest(batch, keys).select(*keys, "value", "ts", "seq"), batch_id)
        table.keep(batch_id, compact_every, older_than("ts", retention))

    return per_batch(metrics, handle, checkpoint, **options)


def rollup_table(spark, path, keys=KEYS, layout=None):
    """The rollup view as a table of partials, divided by stretches of `layout` (a duration) if given."""
    columns = ", ".join(f"{k} string" for k in keys)
    by = ["window_start", "window_end", *keys]
    return PartialTable(
        spark,
        path,
        f"window_start timestamp, window_end timestamp, {columns}, "
        "cnt long, mean double, m2 double, min double, max double",
        lambda partials: merge_moments(partials, by).withColumn("stddev", sample_stddev()),
        layout and ("window_start", layout),
    )


def older_than(ts, retention):
    """The condition that a time is longer ago than `retention`; none without one."""
    if retention is None:
        return None
    return F.col(ts) < F.current_timestamp() - F.expr(f"interval {micros(retention)} microseconds")


def start_rollup_view(metrics, table, checkpoint, size="1 minute", keys=KEYS, compact_every=COMPACT_EVERY, retention=None, **options):
    """Keep count, mean, min, max and stddev per window and key in `table`, folded after every
    `compact_every` batches; with `retention` folding leaves out windows that ended before it."""

    def handle(batch, batch_id):
        partials = batch.groupBy(F.window("ts", size).alias("w"), *keys).agg(*partial_moments())
        bounds = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]
        table.write(partials.select(*bounds, *keys, "cnt", "mean", "m2", "min", "max"), batch_id)
        table.keep(batch_id, compact_every, older_than("window_end", retention))

    return per_batch(metrics, handle, checkpoint, **options)


RULE_CHANGES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.RULES.fields)


def rule_change_table(spark, path):
    """The last change per rule as a table of partials: all columns, removals included.

    `read()` gives the last change of every rule ever seen; `current_rules` over it leaves
    out the removed ones.
    """
    return PartialTable(
        spark, path, RULE_CHANGES, lambda changes: newest_rows(changes, ["rule_id"], ["updated_at", "seq"])
    )


def start_rule_changes(changes, table, checkpoint, compact_every=COMPACT_EVERY, **options):
    """Keep the last change per rule out of a stream of rule changes, folded after every
    `compact_every` batches; columns not sent are null."""

    def handle(batch, batch_id):
        none = {f.name: F.lit(None).cast(f.dataType) for f in schema.RULES.fields if f.name not in batch.columns}
        full = batch.withColumns(none).select(*[F.col(f.name).cast(f.dataType) for f in schema.RULES.fields])
        table.write(table.merge(full), batch_id)
        table.keep(batch_id, compact_every)

    return per_batch(changes, handle, checkpoint, **options)


def start_counts(metrics, load_rules, path, checkpoint, **options):
    """Per batch and metric: rows not detected, detected, and all, kept by batch number."""

    def handle(batch, batch_id):
        with version(load_rules, batch_id) as rules:
            numbered = rule.check(batch, rules_of_kind(rules, "threshold")).withColumn("_b", F.lit(batch_id))
            batch_folder(counting.batch_counts(numbered, "_b").drop("_b"), path, batch_id)

    return per_batch(metrics, handle, checkpoint, **options)


COUNTS = "metric string, not_detected long, detected long, batch_count long"


def last_in_window(metrics, size="10 seconds", late="20 seconds", keys=KEYS):
    """Last value per window and key, each window once, when `late` has passed it."""
    return (
        metrics.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), *keys)
        .agg(F.max_by("value", ordinal()).alias("value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "value")
    )


def closed_rollups(metrics, size="1 minute", late="70 seconds", keys=KEYS):
    """Rollups of windows that are closed, each once; rows later than `late` are dropped."""
    return (
        metrics.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), *keys)
        .agg(
            F.count("value").alias("cnt"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.stddev_samp("value").alias("stddev"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *keys,
            "cnt",
            "mean",
            "min",
            "max",
            "stddev",
        )
    )


def window_alarms(metrics, condition, size="1 minute", slide="1 second", mark_count=1, keys=()):
    """Sliding windows in which `mark_count` rows met a condition, when they are closed.

    The watermark is as long as the window. Rows are counted in panes of the greatest common
    divisor of size and slide first; only panes are copied into windows.
    """
    pane = duration(gcd(micros(size), micros(slide)))
    panes = (
        metrics.where(condition)
        .withWatermark("ts", size)
        .groupBy(F.window("ts", pane).alias("_p"), *keys)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return (
        panes.groupBy(F.window("_p", size, slide).alias("w"), *keys)
        .agg(F.sum("cnt").alias("cnt"))
        .where(F.col("cnt") >= mark_count)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "cnt")
    )


def window_join(metrics, window_condition, join_condition, size, slide=None, mark_count=1, keys=("resource",), late="1 hour"):
    """`windows.window_join` on a stream: rows meeting one condition inside closed windows in which
    another one reached its mark.

    A join of two streams on window and keys. The counts of a window come when the watermark, `late`
    behind the newest row, has passed its end; until then its rows wait in state, and both sides are
    let go with it, so state holds the rows of open windows only.
    """
    seen = metrics.withWatermark("ts", late)
    window = F.window("ts", duration(micros(size)), duration(micros(slide or size)))
    marked = seen.where(window_condition).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("cnt"))
    # The window is the time that counts from here on.
    plain_time = F.timestamp_micros(F.unix_micros("ts"))
    others = seen.where(join_condition).withColumn("w", window).withColumn("_ts", plain_time).drop("ts").withColumnRenamed("_ts", "ts")
    joined = others.join(marked.where(F.col("cnt") >= mark_count), ["w", *keys])
    bounds = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]
    return joined.select(*bounds, *[c for c in metrics.columns], "cnt")


def start_upserts(counted, path, keys, checkpoint, **options):
    """A stateful aggregate in update mode: each micro-batch writes the groups that changed, as a table
    of partials whose newest row per key counts. Returns the query and the table."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema.fields)

    def newest(rows):
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")

    table = PartialTable(counted.sparkSession, path, f"{columns}, batch_id long", newest)

    def handle(batch, batch_id):
        table.write(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id)
        table.keep(batch_id)

    return per_batch(counted, handle, checkpoint, mode="update", **options), table


def start_table(df, path, checkpoint, **options):
    """Append a stream to a parquet table, each row exactly once."""
    return _writer(df, checkpoint, **options).format("parquet").option("path", path).start()


def start_kafka(alarms, servers, topic, checkpoint, **options):
    """Send alarms to a Kafka topic as JSON."""
    out = alarms.select(F.col("rule_id").alias("key"), encode_alarm().alias("value"))
    writer = _writer(out, checkpoint, **options).format("kafka")
    return writer.option("kafka.bootstrap.servers", servers).option("topic", topic).start()


def start_memory(df, name, checkpoint=None, mode="append"):
    """A stream as an in-memory table of the driver: for tests and small results only."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def print_console(df, rows=20):
    """Show a batch, or every micro-batch of a stream, on the console."""
    if not df.isStreaming:
        df.show(rows, truncate=False)
        return None
    writer = df.writeStream.format("console").option("truncate", "false").option("numRows", rows)
    return writer.start()


def start_all(metrics, load_rules, base, **options):
    """Detection, continuous alarms on its alarms, state view and rollup view, each with its own
    checkpoint.

    Rules of all kinds may be in one table: each query takes its own. Returns the queries; wait
    with `spark.streams.awaitAnyTermination()`.
    """
    from pulsewatch.streaming.streaks import start_continuous_alarms

    spark = metrics.sparkSession
    state = state_table(spark, f"{base}/state_view")
    rollups = rollup_table(spark, f"{base}/rollup_view")
    make_folder(spark, f"{base}/alarms")
    return {
        "detect": start_detection(
            metrics, load_rules, f"{base}/alarms", f"{base}/_checkpoint/detect", **options
        ),
        "continuous": start_continuous_alarms(
            batch_stream(spark, f"{base}/alarms", ALARMS),
            load_rules,
            f"{base}/continuous_alarms",
            f"{base}/_checkpoint/continuous",
            **options,
        ),
        "state_view": start_state_view(metrics, state, f"{base}/_checkpoint/state_view", **options),
        "rollup_view": start_rollup_view(
            metrics, rollups, f"{base}/_checkpoint/rollup_view", **options
        ),
    }
