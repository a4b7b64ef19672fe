"""Matching metric rows against a table of rules."""

from functools import reduce

from pyspark.sql import functions as F

from pulsewatch.functions.encode import metric_rule_payload
from pulsewatch.functions.predicates import compare, log_condition, summary_value
from pulsewatch.operators.rulebook import newest_rows
from pulsewatch.operators.sizing import fits_broadcast, keyed_join, salted_join, salted_sides
from pulsewatch.session import cut_lineage

KEYS = ("resource", "metric")
LISTED_RULES = 100_000


def _rule_columns(rules, keys, *more):
    return rules.select("rule_id", *keys, "op", "threshold", *more)


def detect(metrics, rules, keys=KEYS, value="value"):
    """Every metric row with every rule on its key, and whether that rule holds.

    Each rule is judged on its own. Rows without a rule on their key are left out; an
    empty rule table gives no rows.
    """
    matched = keyed_join(metrics, _rule_columns(rules, keys), keys, bounded_by=rules)
    return matched.withColumn("detect", compare(F.col(value), F.col("op"), F.col("threshold")))


def check(metrics, rules, keys=KEYS, value="value"):
    """`detect` as 0 or 1 in `chk`."""
    found = detect(metrics, rules, keys, value)
    return found.withColumn("chk", F.col("detect").cast("int")).drop("detect")


def simple_alarms(detections):
    """Detections in alarm form, with the metric row and its rule as JSON payload.

    `metric` and `value` complete the order of rows that share time and sequence.
    """
    payload = metric_rule_payload(
        {c: F.col(c) for c in ("ts", "resource", "metric", "value")},
        {"ruleId": F.col("rule_id"), "op": F.col("op"), "value": F.col("threshold")},
    )
    return detections.select(
        F.lit("simple").alias("alarm_type"),
        "rule_id",
        "detect",
        F.col("detect").cast("int").alias("occur_count"),
        F.col("ts").alias("occur_timestamp"),
        "seq",
        "metric",
        "value",
        payload.alias("payload"),
    )


def both_rule_sets(static, dynamic, keys=KEYS):
    """Static rules and rules learned from a stream, side by side."""
    return _rule_columns(static, keys).unionByName(_rule_columns(dynamic, keys))


def last_rule_per_key(rules, keys=KEYS):
    """One rule per key: the one written last (of equal ones the largest)."""
    return newest_rows(rules.select(*keys, "rule_id", "op", "threshold", "updated_at", "seq"), keys, ["updated_at", "seq"]).select(
        *keys, "rule_id", "op", "threshold"
    )


def has_rule(metrics, rules, keys=KEYS):
    """Metric rows whose key has at least one rule."""
    return keyed_join(metrics, rules.select(*keys).distinct(), keys, "left_semi", bounded_by=rules)


def _rules_per_key(rules, keys, *order):
    listed = F.sort_array(F.collect_list(F.struct(*order, "rule_id", "op", "threshold")))
    return rules.groupBy(*keys).agg(listed.alias("_rules"))


def any_rule_matches(metrics, rules, keys=KEYS, value="value"):
    """Metric rows for which some rule on their key holds, each row once."""
    if fits_broadcast(rules):
        listed = _rules_per_key(_rule_columns(rules, keys), keys)
        found = metrics.join(F.broadcast(listed), list(keys))
        hit = F.exists("_rules", lambda r: compare(F.col(value), r["op"], r["threshold"]))
        return found.where(hit).drop("_rules")
    left, right = salted_sides(metrics, _rule_columns(rules, keys), keys)
    same = [left[c] == right[c] for c in (*keys, "_salt")]
    holds = compare(left[value], right["op"], right["threshold"])
    return left.join(right, [*same, holds], "left_semi").drop("_salt")


def first_match(metrics, rules, keys=KEYS, value="value", order="rule_order", spread=None):
    """Every metric row once, with the first rule that holds or `id = ''`, `chk = 0`.

    Equal rows stay as many as they are. With a measured-small rule table each key's rules
    travel as one ordered list, so metric rows neither multiply nor shuffle. Past the bound
    (or with `spread`) rows are numbered and stored, matched by a salted join, and the first
    match is joined back by row number, so no key's rules are gathered.
    """
    keys = list(keys)
    at = F.struct(F.col(order).alias("at"), "rule_id")
    named = rules.select(*keys, at.alias("_at"), F.col("op").alias("_op"), F.col("threshold").alias("_threshold"))
    if not spread and (spread is False or fits_broadcast(rules)):
        listed = F.sort_array(F.collect_list(F.struct("_at", "_op", "_threshold")))
        joined = metrics.join(F.broadcast(named.groupBy(*keys).agg(listed.alias("_rules"))), keys, "left")
        held = F.filter("_rules", lambda r: compare(F.col(value), r["_op"], r["_threshold"]))
        kept = joined.withColumn("_first", F.get(held, F.lit(0))["_at"]).drop("_rules")
    else:
        numbered = cut_lineage(metrics.withColumn("_row", F.monotonically_increasing_id()))
        slim = numbered.select("_row", *keys, F.col(value).alias("_value"))
        matched = salted_join(slim, named, keys)
        holds = compare(F.col("_value"), F.col("_op"), F.col("_threshold"))
        first = matched.where(holds).groupBy("_row").agg(F.min("_at").alias("_first"))
        kept = numbered.join(first, "_row", "left").drop("_row")
    found = kept.select(*metrics.columns, F.coalesce("_first.rule_id", F.lit("")).alias("id"))
    return found.withColumn("chk", (F.col("id") != "").cast("int"))


def detect_logs(logs, rules, spread=None, listed_rules=LISTED_RULES):
    """Log rows with each log rule they meet.

    Rules travel in lists, those of a resource to its lines, those that name none beside
    every line; lines are tested in place and only hits are emitted. A measured-small rule
    table takes one scan. Past the bound (or with `spread`) lists hold about `listed_rules`
    rules: a resource's lists are joined to its lines by a salted join, and each list
    without a resource, which every line has to be tested against, is broadcast to a scan
    of its own.
    """
    small = not spread and (spread is False or fits_broadcast(rules))
    lists = 1 if small else max(1, -(-rules.count() // listed_rules))
    number = F.pmod(F.xxhash64("rule_id", "op", "keyword"), F.lit(lists)).alias("_list")
    tests = F.collect_list(F.struct("rule_id", "op", "keyword"))
    own = rules.where("resource is not null").groupBy("resource", number).agg(tests.alias("_own")).drop("_list")
    free = rules.where("resource is null").withColumn("_list", number)
    none = F.array().cast("array<struct<rule_id:string,op:string,keyword:string>>")

    def hits(lines, tested):
        met = F.filter(tested, lambda r: log_condition(F.col("log"), r["op"], r["keyword"]))
        found = lines.withColumn("_hit", F.explode(met))
        return found.select(F.col("_hit.rule_id").alias("rule_id"), *logs.columns)

    def beside(lines, n):
        # An aggregate without keys is one row, so no line is copied.
        return lines.join(F.broadcast(free.where(F.col("_list") == n).groupBy().agg(tests.alias("_free"))))

    if small:
        joined = beside(logs.join(F.broadcast(own), ["resource"], "left"), 0)
        return hits(joined, F.concat(F.coalesce("_own", none), "_free"))
    passes = [hits(beside(logs, n), F.col("_free")) for n in range(lists)]
    return reduce(lambda a, b: a.unionByName(b), passes, hits(salted_join(logs, own, ["resource"]), F.col("_own")))


def detect_rollups(rollups, rules, keys=KEYS):
    """Every rollup row with every rollup rule on its key, judged on the rule's summary."""
    matched = keyed_join(rollups, _rule_columns(rules, keys, "summary"), keys, bounded_by=rules)
    chosen = summary_value(F.col("summary"))
    return matched.withColumn("detect", compare(chosen, F.col("op"), F.col("threshold")))


def evaluate_batch(metrics, rules, processed_at=None):
    """Every rule's verdict on a batch with the rule's text and the processing time."""
    found = check(metrics, rules).withColumnRenamed("chk", "detect")
    text = F.concat_ws(" ", "metric", "op", F.col("threshold").cast("string"))
    return found.select(
        (F.current_timestamp() if processed_at is None else processed_at).alias("timestamp"),
        "rule_id",
        "detect",
        "resource",
        F.col("metric").alias("event"),
        "value",
        text.alias("filter"),
    )
