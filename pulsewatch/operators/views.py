"""Latest-value and rollup views, their order, and single lookups on them."""

from pyspark.sql import functions as F

from pulsewatch.functions.predicates import key_match
from pulsewatch.functions.times import ordinal, recent, sequence_of

KEYS = ("resource", "metric")


def latest(metrics, keys=KEYS):
    """Last value per key by (ts, seq), with the time and sequence it was seen at."""
    position = ordinal()
    newest = metrics.groupBy(*keys).agg(
        F.max_by("value", position).alias("value"),
        F.max("ts").alias("ts"),
        F.max(position).alias("_at"),
    )
    return newest.withColumn("seq", sequence_of("_at")).drop("_at")


def state_view(metrics, keys=KEYS, minutes=5, as_of=None):
    """Latest value per key, for keys heard from in the last `minutes`.

    Old rows cannot survive the cut, so the bound is applied to the scan as well.
    """
    return latest(recent(metrics, minutes, as_of), keys)


def rollup(metrics, size="1 minute", keys=KEYS, minutes=None, as_of=None):
    """Count, mean, min, max and sample stddev per window and key.

    With `minutes`, only windows that started at most that long ago.
    """
    if minutes is not None:
        metrics = recent(metrics, minutes, as_of)
    grouped = metrics.groupBy(F.window("ts", size).alias("w"), *keys).agg(
        F.count("value").alias("cnt"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("stddev"),
    )
    shaped = grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *keys,
        "cnt",
        "mean",
        "min",
        "max",
        "stddev",
    )
    return shaped if minutes is None else recent(shaped, minutes, as_of, "window_start")


def last_in_window(metrics, size="10 seconds", keys=KEYS):
    """Last value per window and key."""
    return (
        metrics.groupBy(F.window("ts", size).alias("w"), *keys)
        .agg(F.max_by("value", ordinal()).alias("value"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "value"
        )
    )


def sorted_state(state, *first):
    """State rows by (node group,) resource and metric."""
    return state.orderBy(*first, "resource", "metric")


def sorted_rollups(rollups):
    """Rollup rows by window, resource and metric."""
    return rollups.orderBy("window_start", "resource", "metric")


def newest_windows(rollups, n=5):
    """The `n` newest rollup rows, ties in key order."""
    return rollups.orderBy(F.desc("window_start"), "resource", "metric").limit(n)


def current_value(state, resource, metric):
    """Latest value of one metric, or None."""
    found = state.where(key_match(resource, metric)).select("value").take(1)
    return found[0]["value"] if found else None


def current_value_sql(spark, text):
    """First `value` a query returns, or None."""
    found = spark.sql(text).select("value").take(1)
    return found[0]["value"] if found else None


def rule_holds(df, condition):
    """Whether any row meets the condition."""
    return not df.where(condition).isEmpty()


def run_rule(latest_metrics, condition, handle):
    """Hand the latest metrics that meet a condition to the caller's function."""
    return handle(latest_metrics.where(condition).select("resource", "metric", "value"))

