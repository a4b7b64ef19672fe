"""Composed rules on a stream, judged again only where one of their leaves has changed.

The newest value of each leaf and the verdict of each rule are kept as tables of partials. A
micro-batch brings new values for some leaves; of these only the leaves whose own result changes
matter, and only the rules over such a leaf are folded. What is written are the verdicts that
changed, so the work and the output of a batch follow the changes, not the rules.
"""

from pyspark.sql import functions as F

from pulsewatch.functions.predicates import compare_or_null
from pulsewatch.functions.times import ordinal
from pulsewatch.operators.cep import KEYS, evaluate
from pulsewatch.operators.sizing import keyed_join
from pulsewatch.operators.views import latest
from pulsewatch.session import cut_lineage
from pulsewatch.sources.tables import COMPACT_EVERY, PartialTable, batch_folder
from pulsewatch.streaming.live import per_batch

CHANGES = "rule_id string, result boolean, was boolean"


def newest(keys, *order):
    """A merge that keeps the row with the largest order of each key."""

    def merge(rows):
        rest = [c for c in rows.columns if c not in keys]
        at = ordinal(*order) if len(order) > 1 else F.col(order[0])
        return rows.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in rest])

    return merge


def value_table(spark, path):
    return PartialTable(spark, path, "leaf_id string, value double, ts timestamp, seq long", newest(["leaf_id"], "ts", "seq"))


def verdict_table(spark, path):
    """The verdict of each rule and the batch that gave it."""
    return PartialTable(spark, path, "rule_id string, result boolean, batch_id long", newest(["rule_id"], "batch_id"))


def leaf_result(leaves, seen):
    """What a leaf says of a value seen for it; a leaf's own `value` wins."""
    known = leaves.join(seen, "leaf_id", "left")
    judged = compare_or_null(F.coalesce("_own", "_seen"), F.col("op"), F.col("threshold"))
    return known.select("leaf_id", judged.alias("result"))


def composed_changes(batch, leaves, nodes, values, verdicts, batch_id):
    """(new values of leaves, verdicts that change) by one micro-batch of metric rows.

    A value older than the one a leaf has changes nothing. Before the first batch has been judged
    every rule is folded.
    """
    named = leaves.select("leaf_id", *KEYS, "op", "threshold", F.col("value").alias("_own"))
    wanted = leaves.select(*KEYS).distinct()
    state = latest(keyed_join(batch, wanted, KEYS, "left_semi", bounded_by=leaves), KEYS)
    stamped = state.select(*KEYS, "value", F.col("ts").cast("timestamp").alias("ts"), "seq")
    came = keyed_join(stamped, leaves.select("leaf_id", *KEYS), KEYS, bounded_by=leaves).select("leaf_id", "value", "ts", "seq")
    held = cut_lineage(values.read(before=batch_id).select("leaf_id", "value", "ts", "seq"))
    old = held.select("leaf_id", F.col("value").alias("_before"), ordinal().alias("_at"))
    newer = came.join(old, "leaf_id", "left").where(F.col("_at").isNull() | (ordinal() >= F.col("_at")))
    newer = cut_lineage(newer.select("leaf_id", "value", "ts", "seq", "_before"))
    now = newer.select("leaf_id", F.col("value").alias("_seen"))
    given = verdicts.read(before=batch_id).select("rule_id", F.col("result").alias("was"))
    if given.isEmpty():
        touched = nodes
    else:
        changing = named.join(newer.select("leaf_id", "_before"), "leaf_id")
        before = leaf_result(changing.drop("_before"), changing.select("leaf_id", F.col("_before").alias("_seen")))
        after = leaf_result(changing.drop("_before"), now).withColumnRenamed("result", "_after")
        moved = before.join(after, "leaf_id").where(~F.col("result").eqNullSafe(F.col("_after"))).select("leaf_id")
        rules = nodes.join(moved, "leaf_id", "left_semi").select("rule_id").distinct()
        touched = cut_lineage(nodes.join(rules, "rule_id", "left_semi"))
    asked = named.join(touched.select("leaf_id").distinct(), "leaf_id", "left_semi")
    kept = held.select("leaf_id", F.col("value").alias("_seen")).join(now.select("leaf_id"), "leaf_id", "left_anti")
    found = evaluate(touched, leaf_result(asked, now.unionByName(kept)))
    judged = found.join(given.withColumn("_known", F.lit(True)), "rule_id", "left")
    changed = judged.where(F.col("_known").isNull() | ~F.col("result").eqNullSafe(F.col("was")))
    return newer.drop("_before"), changed.select("rule_id", "result", "was")


def start_composed(metrics, leaves, nodes, path, checkpoint, compact_every=COMPACT_EVERY, **options):
    """The changes of composed rules' verdicts on a stream of metric rows, by batch below `{path}/changes`.

    `leaves` (on the latest value of a metric) and `nodes` are tables as in `cep`. A rule's first
    verdict, which is null while a leaf is missing, counts as a change. A batch that is tried again
    starts from what the batches before it left; one that was finished is not judged twice.
    """
    spark = metrics.sparkSession
    values, verdicts = value_table(spark, f"{path}/values"), verdict_table(spark, f"{path}/verdicts")

    def handle(batch, batch_id):
        if verdicts.holds(batch_id):
            return
        came, changed = composed_changes(batch, leaves, nodes, values, verdicts, batch_id)
        changed = cut_lineage(changed)
        values.write(came, batch_id)
        batch_folder(changed, f"{path}/changes", batch_id)
        # Last, as it settles the batch.
        verdicts.write(changed.select("rule_id", "result", F.lit(batch_id).cast("long").alias("batch_id")), batch_id)
        values.keep(batch_id, compact_every)
        verdicts.keep(batch_id, compact_every)

    return per_batch(metrics, handle, checkpoint, **options)
