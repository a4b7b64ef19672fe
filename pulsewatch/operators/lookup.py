"""Questions asked of the views, many keys per job."""

from pyspark.sql import functions as F

from pulsewatch.functions.moments import merge_moments, sample_stddev
from pulsewatch.functions.predicates import compare, key_match, summary_value
from pulsewatch.functions.times import age_seconds, recent
from pulsewatch.operators.detect import detect
from pulsewatch.operators.sizing import keyed_join

KEYS = ("resource", "metric")


def select_metrics(state, wanted, keys=KEYS):
    """Current values of a list of wanted metrics."""
    return keyed_join(state, wanted.select(*keys), keys, bounded_by=wanted)


def select_rules(state, rules, keys=KEYS):
    """Current values of every ruled metric and whether each rule holds."""
    return detect(state, rules, keys)


def rollup_mean(rollups, minutes, keys=KEYS, as_of=None):
    """Count-weighted mean over the rollups of the last `minutes`, per key; 0 when empty."""
    kept = recent(rollups, minutes, as_of, "window_start")
    age = age_seconds("window_start", as_of)
    weighted = F.sum(F.col("mean") * F.col("cnt")) / F.nullif(F.sum("cnt"), F.lit(0))
    return kept.groupBy(*keys).agg(
        F.sum("cnt").alias("total_cnt"),
        F.coalesce(weighted, F.lit(0.0)).alias("mean"),
        F.min(age).alias("min_age"),
        F.max(age).alias("max_age"),
    )


def rollup_mean_value(rollups, resource, metric, minutes, as_of=None):
    """The same for one metric as a number; 0.0 when there is nothing to average."""
    one = rollups.where(key_match(resource, metric))
    found = rollup_mean(one, minutes, as_of=as_of).select("mean").take(1)
    return found[0]["mean"] if found else 0.0


def rollup_rules(rollups, rules, minutes, keys=KEYS, as_of=None):
    """Rollup rules judged on the merged rollups of the last `minutes` of their key."""
    ruled = keyed_join(rollups, rules.select(*keys).distinct(), keys, "left_semi", bounded_by=rules)
    age = age_seconds("window_start", as_of)
    kept = recent(ruled, minutes, as_of, "window_start").withColumn("_age", age)
    spread = F.coalesce(F.col("stddev") * F.col("stddev") * (F.col("cnt") - 1), F.lit(0.0))
    ages = (F.min("_age").alias("min_age"), F.max("_age").alias("max_age"))
    summary = (
        merge_moments(kept.withColumn("m2", spread), keys, *ages)
        .withColumn("mean", F.coalesce("mean", F.lit(0.0)))
        .withColumn("stddev", sample_stddev())
    )
    named = rules.select("rule_id", *keys, "summary", "op", "threshold")
    judged = keyed_join(summary, named, keys, bounded_by=rules)
    chosen = summary_value(F.col("summary"))
    return judged.select(
        "rule_id",
        *keys,
        "summary",
        F.col("cnt").alias("total_cnt"),
        "mean",
        "min_age",
        "max_age",
        compare(chosen, F.col("op"), F.col("threshold")).alias("detect"),
    )
