"""Rules composed of other rules with AND and OR.

A composed rule is a table with one row per leaf and the `path` of connectives from the
leaf up to the whole rule. Rules are judged by one aggregate per level of the deepest one:
leaves that share a path fold into the node above them. The table is as long as the rules
have leaves. Both connectives are strict: a rule with one missing leaf is missing, even
`true OR missing`, unlike SQL's three-valued logic.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewatch.functions.predicates import compare_or_null, summary_value
from pulsewatch.functions.times import instant, ordinal
from pulsewatch.operators.continuous import current_streaks
from pulsewatch.operators.sizing import keyed_join
from pulsewatch.operators.views import latest
from pulsewatch.operators.windows import sliding_sums
from pulsewatch.session import cut_lineage
from pulsewatch.sources.rules import small_frame

KEYS = ("resource", "metric")
#: Levels folded in one plan before the rows so far are written out.
LEVELS_A_PLAN = 8
NODES = "rule_id string, leaf_id string, path array<struct<node:long,every:boolean>>"
LEAVES = (
    "leaf_id string, resource string, metric string, op string, threshold double, value double, "
    "target_rule_id string, mark_count long, agg string, span long"
)


class _Expression:
    def __and__(self, other):
        return All(self, other)

    def __or__(self, other):
        return Any(self, other)


@dataclass(frozen=True)
class Leaf(_Expression):
    """A rule by its id."""

    name: str

    @property
    def id(self):
        return self.name


@dataclass(frozen=True)
class _Pair(_Expression):
    left: _Expression
    right: _Expression

    @property
    def id(self):
        return f"{self.left.id}:{self.right.id}"

    def sides(self):
        """What this connective joins, chains of the same one taken together."""
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if type(e) is type(self):
                todo += [e.right, e.left]
            else:
                out.append(e)
        return out


class All(_Pair):
    """Both sides hold."""


class Any(_Pair):
    """Either side holds."""


def node_rows(expression, rule_id=None):
    """Rows of the node table for one expression; its id is that of its leaves in order."""
    name = expression.id if rule_id is None else rule_id
    out, todo, number = [], [(expression, [])], 0
    while todo:
        e, path = todo.pop()
        if isinstance(e, Leaf):
            out.append((name, e.name, path))
        else:
            above = [{"node": number, "every": isinstance(e, All)}, *path]
            number += 1
            todo += [(side, above) for side in reversed(e.sides())]
    return out


def leaf_frame(spark, leaves):
    """Leaves given as dicts, as a table; columns not named are null."""
    declared = T.StructType.fromDDL(LEAVES)
    names = declared.fieldNames()
    return small_frame(spark, [[leaf.get(n) for n in names] for leaf in leaves], declared)


def node_frame(spark, *expressions):
    """The node table of composed rules, each an expression or an (id, expression) pair.

    `a & b` and `a | b` have the same id; rules with one id are refused, not merged.
    """
    named = [e if isinstance(e, tuple) else (e.id, e) for e in expressions]
    ids = [name for name, _ in named]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise ValueError(f"several composed rules are called {twice}: give them ids of their own")
    rows = [row for name, e in named for row in node_rows(e, name)]
    return small_frame(spark, rows, T.StructType.fromDDL(NODES))


def value_leaves(leaves, metrics):
    """Leaves on the latest value of a metric; a leaf's own `value` wins over the lookup.

    Rows of other metrics are dropped before the latest value is worked out.
    """
    wanted = leaves.select(*KEYS).distinct()
    state = latest(keyed_join(metrics, wanted, KEYS, "left_semi", bounded_by=leaves), KEYS)
    state = state.select(*KEYS, F.col("value").alias("_seen"))
    found = F.coalesce("value", "_seen")
    return leaves.join(state, list(KEYS), "left").select(
        "leaf_id", compare_or_null(found, F.col("op"), F.col("threshold")).alias("result")
    )


def streak_leaves(leaves, detections):
    """Leaves on the run a rule is in: at least `mark_count` long. No rows is a run of 0."""
    targets = leaves.select(F.col("target_rule_id").alias("rule_id")).distinct()
    runs = current_streaks(keyed_join(detections, targets, ["rule_id"], "left_semi", bounded_by=leaves))
    runs = runs.withColumnRenamed("rule_id", "target_rule_id")
    reached = F.coalesce("streak", F.lit(0)) >= F.col("mark_count")
    return leaves.join(runs, "target_rule_id", "left").select("leaf_id", reached.alias("result"))


def range_leaves(leaves, metrics, as_of=None):
    """Leaves on min, max, mean or population stddev over a leaf's own trailing range.

    `span` is in seconds. Rows older than the longest span are cut at the scan.
    """
    longest = leaves.agg(F.max("span")).first()[0] or 0
    kind = metrics.schema["ts"].dataType
    now = instant(as_of)
    start = (now - F.make_dt_interval(secs=F.lit(longest))).cast(kind)
    near = metrics.where(F.col("ts").between(start, now.cast(kind)))
    named = leaves.select("leaf_id", *KEYS, "span")
    own_start = (now - F.make_dt_interval(secs=F.col("span"))).cast(kind)
    within = keyed_join(near, named, KEYS, bounded_by=leaves).where(F.col("ts") >= own_start)
    stats = within.groupBy("leaf_id").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("stddev"),
    )
    names = {c: c for c in ("min", "max", "mean", "stddev")}
    chosen = summary_value(F.col("agg"), names)
    return leaves.join(stats, "leaf_id", "left").select(
        "leaf_id", compare_or_null(chosen, F.col("op"), F.col("threshold")).alias("result")
    )


def _latest_alarms(leaves, alarms):
    targets = leaves.select(F.col("target_rule_id").alias("rule_id")).distinct()
    position = ordinal("occur_timestamp", "seq")
    return (
        keyed_join(alarms, targets, ["rule_id"], "left_semi", bounded_by=leaves)
        .groupBy(F.col("rule_id").alias("target_rule_id"))
        .agg(
            F.max_by("detect", position).alias("_alarm"),
            F.max_by(F.col("occur_count").cast("double"), position).alias("_count"),
        )
    )


def alarm_leaves(leaves, alarms):
    """Leaves on the newest alarm of a rule: set or not. A rule never seen is not set."""
    state = _latest_alarms(leaves, alarms)
    is_set = F.coalesce("_alarm", F.lit(False))
    return leaves.join(state, "target_rule_id", "left").select("leaf_id", is_set.alias("result"))


def alarm_value_leaves(leaves, alarms):
    """Leaves on the count the newest alarm of a rule carries; missing for a rule never seen."""
    state = _latest_alarms(leaves, alarms)
    judged = compare_or_null(F.col("_count"), F.col("op"), F.col("threshold"))
    return leaves.join(state, "target_rule_id", "left").select("leaf_id", judged.alias("result"))


def evaluate(nodes, results, at=()):
    """Verdict per composed rule: true, false, or NULL when any of its leaves is missing.

    Each level is one aggregate over the leaves of that level and what the level below it
    folded to, so the plan grows with the depth and a row is read at its own level only.
    With `at`, leaf results carry these further columns and a verdict is given wherever
    a rule has at least one leaf result.
    """
    at = list(at)
    sizes = nodes.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_leaves"), F.max(F.size("path")).alias("_depth"))
    depth = sizes.agg(F.max("_depth")).first()[0] or 0
    found = keyed_join(results, nodes, ["leaf_id"], bounded_by=nodes)
    found = found.select(*at, "rule_id", "path", "result", F.col("result").isNotNull().cast("long").alias("_known"))
    if depth:
        # Read once a level below.
        found = cut_lineage(found)
    here = found.where(F.size("path") == depth)
    for level in range(depth, 0, -1):
        folded = here.groupBy(*at, "rule_id", "path").agg(
            F.bool_and("result").alias("_all"), F.bool_or("result").alias("_any"), F.sum("_known").alias("_known")
        )
        folded = folded.select(
            *at,
            "rule_id",
            F.slice("path", 2, depth).alias("path"),
            F.when(F.col("path")[0]["every"], F.col("_all")).otherwise(F.col("_any")).alias("result"),
            "_known",
        )
        here = found.where(F.size("path") == level - 1).unionByName(folded)
        if level % LEVELS_A_PLAN == 1 and level > 1:
            here = cut_lineage(here)
    found = here
    verdicts = found.join(sizes, "rule_id").select(
        *at, "rule_id", F.when(F.col("_known") == F.col("_leaves"), F.col("result")).alias("result")
    )
    return verdicts if at else sizes.select("rule_id").join(verdicts, "rule_id", "left")


def composed_windows(metrics, leaves, nodes, size, step, mark_count=1):
    """Windows in which a composed rule held in at least `mark_count` of their steps.

    In each step the rule is judged on the last value every leaf's metric had in it.
    """
    wanted = leaves.select(*KEYS).distinct()
    seen = keyed_join(metrics, wanted, KEYS, "left_semi", bounded_by=leaves)
    last = (
        seen.groupBy(*KEYS, F.window("ts", step).alias("_w"))
        .agg(F.max_by("value", ordinal()).alias("_seen"))
        .withColumn("step", F.col("_w.start"))
    )
    named = leaves.select("leaf_id", *KEYS, "op", "threshold")
    judged = keyed_join(last, named, KEYS, bounded_by=leaves).select(
        "step", "leaf_id", compare_or_null(F.col("_seen"), F.col("op"), F.col("threshold")).alias("result")
    )
    held = evaluate(nodes, judged, ["step"]).where("result")
    counted = sliding_sums(held, size, step, ["rule_id"], ts="step")
    return counted.where(F.col("cnt") >= mark_count)

