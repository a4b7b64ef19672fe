"""Metrics judged by the rules that were in force at their own time."""

from pyspark.sql import functions as F

from pulsewatch.functions.predicates import compare
from pulsewatch.functions.times import epoch_micros
from pulsewatch.operators.ordered import previous
from pulsewatch.operators.sizing import keyed_join, salted_join
from pulsewatch.session import cut_lineage

KEYS = ("resource", "metric")
HOT_ROWS = 1_000_000
OPEN_END = (1 << 62) - 1


def validity(changes, columns=("resource", "metric", "op", "threshold")):
    """Spans in which a version of a rule was in force: `_from` and `_to` in microseconds, half open.

    A change holds from its time until the next change of its rule by (updated_at, seq); the last one
    has no end. Removals end a span and start none; changes at one time leave only the last.
    """
    removed = F.col("deleted") if "deleted" in changes.columns else F.lit(False)
    told = changes.select(
        "rule_id",
        *columns,
        F.coalesce(removed, F.lit(False)).alias("_gone"),
        epoch_micros("updated_at").alias("_from"),
        (-epoch_micros("updated_at")).alias("_back"),
        (-F.coalesce("seq", F.lit(0))).alias("_back_seq"),
    )
    told = told.withColumn("_tie", F.xxhash64("rule_id", *columns, "_gone"))
    ended = previous(told, ["rule_id"], ["_back", "_back_seq", "_tie"], "_from", "_to")
    ended = ended.withColumn("_to", F.coalesce("_to", F.lit(OPEN_END)))
    return ended.where(~F.col("_gone") & (F.col("_from") < F.col("_to"))).select("rule_id", *columns, "_from", "_to")


def detect_as_of(metrics, changes, keys=KEYS, value="value", ts="ts"):
    """Every metric row with every rule on its key that was in force at the row's time, and whether it holds.

    An interval join by length classes: a span of under 2^c microseconds is filed under the at most
    two stretches of 2^c it touches, and a metric row asks, for the classes its key has, for the
    stretch it lies in. Key, class and stretch are equal for all that match, and what meets there
    and does not match is of the order of what does, so no row meets the whole history of its key. Hot
    keys and stretches are split over many tasks, which are sized by the rows that ask. Spans without
    an end are cut at the newest metric.
    """
    keys = list(keys)
    spans = cut_lineage(validity(changes, (*keys, "op", "threshold")))
    rows = metrics.withColumn("_at", epoch_micros(ts))
    newest = rows.agg(F.max("_at")).first()[0] or 0
    end = F.least(F.col("_to"), F.greatest(F.lit(newest + 1), F.col("_from") + 1))
    # The number of bits of a length: two to its power is longer.
    bits = F.length(F.bin(F.col("_end") - F.col("_from"))).cast("int")
    classed = spans.withColumn("_end", end).withColumn("_class", bits)
    touched = F.array_distinct(F.array(F.expr("shiftright(_from, _class)"), F.expr("shiftright(_end - 1, _class)")))
    filed = classed.withColumn("_stretch", F.explode(touched)).drop("_end")
    classes = filed.groupBy(*keys).agg(F.collect_set("_class").alias("_classes"))
    classes = cut_lineage(classes)
    asking = rows.groupBy(*keys).count().join(classes, keys).agg(F.sum(F.col("count") * F.size("_classes"))).first()[0]
    asked = keyed_join(rows, classes, keys).withColumn("_class", F.explode("_classes")).drop("_classes")
    asked = asked.withColumn("_stretch", F.expr("shiftright(_at, _class)"))
    met = salted_join(asked, filed, [*keys, "_class", "_stretch"], hot_rows=HOT_ROWS, rows=asking or 0)
    held = met.where((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to")))
    judged = held.withColumn("detect", compare(F.col(value), F.col("op"), F.col("threshold")))
    return judged.select(*metrics.columns, "rule_id", "op", "threshold", "detect")
