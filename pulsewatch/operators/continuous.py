"""Continuous alarms: a rule that has held several times in a row."""

from pyspark.sql import functions as F

from pulsewatch.functions.encode import rule_payload
from pulsewatch.functions.times import ordinal
from pulsewatch.operators.ordered import streaks
from pulsewatch.operators.sizing import keyed_join


#: A full order: rows of one message share time and sequence, and differ in metric or value.
ORDER = ("occur_timestamp", "seq", "metric", "value")


def streak_rows(detections, order, limit=None):
    """Detections with the length of the run of detections each one ends.

    Of rows equal in `order` those that do not detect come first.
    """
    held = F.coalesce("detect", F.lit(False)).cast("int").alias("_held")
    ranked = detections.select("*", held)
    return streaks(ranked, ["rule_id"], [*order, "_held"], "detect", limit).drop("_held")


def continuous_form(counted, rules):
    """Alarms of counted rows (`target_rule_id`, order, `streak`) that reach a rule's mark."""
    named = rules.select("rule_id", "target_rule_id", "mark_count")
    paired = keyed_join(counted, named, ["target_rule_id"], bounded_by=rules)
    payload = rule_payload(
        {
            "ruleId": F.col("rule_id"),
            "targetRuleId": F.col("target_rule_id"),
            "markCount": F.col("mark_count"),
        }
    )
    return paired.where(F.col("streak") >= F.col("mark_count")).select(
        F.lit("continuous").alias("alarm_type"),
        "rule_id",
        "target_rule_id",
        F.lit(True).alias("detect"),
        F.col("streak").cast("long").alias("occur_count"),
        *ORDER,
        payload.alias("payload"),
    )


def continuous_alarms(detections, rules, ts="ts", seq="seq", limit=None):
    """An alarm for every detection whose run has reached a continuous rule's mark.

    Runs follow (time, sequence, metric, value) per target rule and are counted once,
    however many continuous rules watch that target. An alarm keeps firing until a row that
    does not detect resets the run. The result has the columns of a detection, so it can be
    watched by further continuous rules.
    """
    targets = rules.select(F.col("target_rule_id").alias("rule_id")).distinct()
    missing = {"metric": "string", "value": "double"}
    full = detections.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in detections.columns})
    verdicts = full.select("rule_id", "detect", F.col(ts).alias("occur_timestamp"), F.col(seq).alias("seq"), *ORDER[2:])
    watched = keyed_join(verdicts, targets, ["rule_id"], "left_semi", bounded_by=rules)
    counted = streak_rows(watched, ORDER, limit).withColumnRenamed("rule_id", "target_rule_id")
    return continuous_form(counted, rules)


def current_streaks(detections, ts="ts", seq="seq"):
    """Length of the run each rule is in now, in the order of `continuous_alarms`.

    The run is the number of rows after the last one that did not detect. Time and sequence of
    that one come from a hash aggregate, and only rows that share them are compared by
    metric and value, so no rule's history is sorted.
    """
    missing = {"metric": "string", "value": "double"}
    full = detections.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in detections.columns})
    placed = full.select(
        "rule_id",
        F.coalesce("detect", F.lit(False)).alias("detect"),
        ordinal(ts, seq).alias("_at"),
        F.struct("metric", "value").alias("_among"),
    )
    breaks = placed.groupBy("rule_id").agg(F.max(F.when(~F.col("detect"), F.col("_at"))).alias("_break"))
    tied = placed.where(~F.col("detect")).join(breaks.where("_break is not null"), "rule_id").where("_at = _break")
    last = tied.groupBy("rule_id").agg(F.max("_among").alias("_last"))
    after = keyed_join(placed, breaks.join(last, "rule_id", "left"), ["rule_id"], derived=True)
    behind = F.col("detect") & (F.col("_among") >= F.col("_last"))
    running = F.col("_break").isNull() | (F.col("_at") > F.col("_break")) | ((F.col("_at") == F.col("_break")) & behind)
    return after.groupBy("rule_id").agg(F.count_if(running).alias("streak"))
