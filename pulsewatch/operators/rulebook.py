"""The rules in force, out of a history of rule changes."""

from pyspark.sql import functions as F

from pulsewatch.functions.times import ordinal


def newest_rows(rows, keys, order):
    """One row per key: the one with the largest `order`, of several such any fixed one.

    Hash aggregates of numbers find each key's last position and, for rows that share it,
    one hash of the rest; rows are joined to these, so nothing is sorted to aggregate.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    placed = rows.withColumn("_at", ordinal(*order)).withColumn("_h", F.xxhash64(*rest))
    last = placed.groupBy(*keys).agg(F.max("_at").alias("_at"))
    top = placed.join(last, [placed[c].eqNullSafe(last[c]) for c in (*keys, "_at")], "left_semi")
    one = top.groupBy(*keys).agg(F.max("_h").alias("_h"))
    found = top.join(one, [top[c].eqNullSafe(one[c]) for c in (*keys, "_h")], "left_semi")
    return found.drop("_at", "_h").distinct()


def current_rules(changes, columns=("resource", "metric", "op", "threshold")):
    """Last change per rule by (updated_at, seq), without rules whose last change removed them."""
    removed = F.col("deleted") if "deleted" in changes.columns else F.lit(False)
    slim = changes.select(
        "rule_id", *columns, "updated_at", "seq", F.coalesce(removed, F.lit(False)).alias("_gone")
    )
    newest = newest_rows(slim, ["rule_id"], ["updated_at", "seq"])
    return newest.where(~F.col("_gone")).select("rule_id", *columns, "updated_at")


def rules_of_kind(rules, *kinds):
    """Rules of the given kinds. Without a kind, a rule that watches another one is continuous
    and any other a threshold rule."""
    watches = F.col("target_rule_id").isNotNull() if "target_rule_id" in rules.columns else F.lit(False)
    kind = F.when(watches, "continuous").otherwise("threshold")
    if "kind" in rules.columns:
        kind = F.coalesce("kind", kind)
    return rules.where(kind.isin(*kinds))
