import datetime as dt

import pytest
from conftest import METRICS, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pulsewatch.operators import cep

L = cep.Leaf
NAMES = ["a", "b", "c", "d"]
RESULTS = "leaf_id string, result boolean"
T0 = dt.datetime(2024, 1, 1)


def strict(e, known):
    """The meaning of a composed rule: missing wherever a side is missing."""
    if isinstance(e, cep.Leaf):
        return known[e.name]
    left, right = strict(e.left, known), strict(e.right, known)
    if left is None or right is None:
        return None
    return left and right if isinstance(e, cep.All) else left or right


expressions = st.recursive(
    st.sampled_from(NAMES).map(L),
    lambda inner: st.tuples(st.booleans(), inner, inner).map(lambda t: t[1] & t[2] if t[0] else t[1] | t[2]),
    max_leaves=6,
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(expressions, min_size=1, max_size=6), st.tuples(*[st.sampled_from([True, False, None])] * 4))
def test_tables_agree_with_the_tree(spark, rules, values):
    known = dict(zip(NAMES, values))
    results = spark.createDataFrame(list(known.items()), RESULTS)
    nodes = cep.node_frame(spark, *[(f"r{i}", e) for i, e in enumerate(rules)])
    found = dict(map(tuple, cep.evaluate(nodes, results).collect()))
    assert found == {f"r{i}": strict(e, known) for i, e in enumerate(rules)}


@pytest.mark.parametrize(
    "rule, expected",
    [(L("t") | L("missing"), None), (L("f") & L("missing"), None), (L("t") | L("f"), True), (L("t") & L("f"), False), (L("t") | L("gone"), None)],
)
def test_missing_is_not_sql_null(spark, rule, expected):
    results = spark.createDataFrame([("t", True), ("f", False), ("missing", None)], RESULTS)
    assert rows(cep.evaluate(cep.node_frame(spark, ("r", rule)), results)) == [("r", expected)]


def test_ids_follow_leaf_order():
    rule = L("1") & L("2") | L("3")
    assert rule.id == "1:2:3"
    both, either = {"node": 1, "every": True}, {"node": 0, "every": False}
    assert cep.node_rows(rule) == [("1:2:3", "1", [both, either]), ("1:2:3", "2", [both, either]), ("1:2:3", "3", [either])]


def test_rules_with_one_id_are_refused(spark):
    with pytest.raises(ValueError, match="a:b"):
        cep.node_frame(spark, L("a") & L("b"), L("a") | L("b"))
    assert cep.node_frame(spark, L("a") & L("b"), ("or", L("a") | L("b"))).count() == 4


def test_nested_rules_stay_as_long_as_their_leaves(spark):
    pairs = [L(f"a{i}") | L(f"b{i}") for i in range(20)]
    rule = pairs[0]
    for p in pairs[1:]:
        rule = rule & p
    nodes = cep.node_frame(spark, ("r", rule))
    assert nodes.count() == 40
    results = spark.createDataFrame([(f"{c}{i}", (c == "a") == (i % 2 == 0)) for c in "ab" for i in range(20)], RESULTS)
    assert rows(cep.evaluate(nodes, results)) == [("r", True)]


def test_worked_example(spark, make):
    """90 > 80 AND 90 > 100 OR 90 > 80, with given values, holds."""
    leaves = cep.leaf_frame(
        spark,
        [
            {"leaf_id": i, "resource": "server1", "metric": m, "value": 90.0, "op": ">", "threshold": t}
            for i, m, t in [("1", "cpu", 80.0), ("2", "mem", 100.0), ("3", "mem", 80.0)]
        ],
    )
    results = cep.value_leaves(leaves, make(METRICS, []))
    assert rows(cep.evaluate(cep.node_frame(spark, L("1") & L("2") | L("3")), results)) == [("1:2:3", True)]


def test_value_leaves(spark, make):
    metrics = make(METRICS, [(T0, 1, "s", "cpu", 5.0), (T0, 2, "s", "cpu", 50.0), (T0, 3, "s", "mem", None)])
    leaves = cep.leaf_frame(
        spark,
        [
            {"leaf_id": "now", "resource": "s", "metric": "cpu", "op": ">", "threshold": 40.0},
            {"leaf_id": "given", "resource": "s", "metric": "cpu", "op": ">", "threshold": 40.0, "value": 1.0},
            {"leaf_id": "absent", "resource": "s", "metric": "disk", "op": ">", "threshold": 0.0},
            {"leaf_id": "null", "resource": "s", "metric": "mem", "op": ">", "threshold": 0.0},
            {"leaf_id": "op", "resource": "s", "metric": "cpu", "op": "?", "threshold": 0.0},
        ],
    )
    assert rows(cep.value_leaves(leaves, metrics)) == [
        ("absent", None), ("given", False), ("now", True), ("null", None), ("op", None),
    ]


def test_streak_range_and_alarm_leaves(spark, make):
    detections = make(
        "rule_id string, ts timestamp, seq long, detect boolean",
        [("r", T0 + dt.timedelta(seconds=i), i, i != 1) for i in range(4)],
    )
    leaves = cep.leaf_frame(
        spark,
        [{"leaf_id": f"{t}{n}", "target_rule_id": t, "mark_count": n} for t, n in [("r", 2), ("r", 3), ("x", 0), ("x", 1)]],
    )
    assert rows(cep.streak_leaves(leaves, detections)) == [("r2", True), ("r3", False), ("x0", True), ("x1", False)]

    metrics = make(METRICS, [(T0 - dt.timedelta(seconds=s), s, "s", "cpu", v) for s, v in [(1, 2.0), (5, 4.0), (50, 90.0)]])
    spans = [
        {"leaf_id": f"{a}{s}", "resource": "s", "metric": "cpu", "agg": a, "span": s, "op": "=", "threshold": t}
        for a, s, t in [("mean", 10, 3.0), ("stddev", 10, 1.0), ("max", 60, 90.0), ("min", 0, 1.0), ("sum", 10, 6.0)]
    ]
    found = cep.range_leaves(cep.leaf_frame(spark, spans), metrics, "2024-01-01 00:00:00")
    assert rows(found) == [("max60", True), ("mean10", True), ("min0", None), ("stddev10", True), ("sum10", None)]

    alarms = make(
        "rule_id string, occur_timestamp timestamp, seq long, detect boolean, occur_count int",
        [("r", T0, 1, False, 0), ("r", T0 + dt.timedelta(seconds=1), 2, True, 1)],
    )
    marks = cep.leaf_frame(
        spark, [{"leaf_id": t, "target_rule_id": t, "op": ">=", "threshold": 1.0} for t in ("r", "x")]
    )
    assert rows(cep.alarm_leaves(marks, alarms)) == [("r", True), ("x", False)]
    assert rows(cep.alarm_value_leaves(marks, alarms)) == [("r", True), ("x", None)]


def test_composed_windows(spark, make):
    def row(minute, metric, value):
        return (T0 + dt.timedelta(minutes=minute), minute, "s", metric, value)

    metrics = make(
        METRICS,
        [row(0, "cpu", 9.0), row(0, "mem", 9.0), row(1, "cpu", 9.0), row(2, "cpu", 9.0), row(2, "mem", 9.0), row(3, "mem", 9.0)],
    )
    leaves = cep.leaf_frame(
        spark, [{"leaf_id": m, "resource": "s", "metric": m, "op": ">", "threshold": 5.0} for m in ("cpu", "mem")]
    )
    either = cep.node_frame(spark, ("r", L("cpu") | L("mem")))
    # Minutes 1 and 3 lack a leaf, so only 0 and 2 count although OR has one true side.
    found = cep.composed_windows(metrics, leaves, either, "4 minutes", "4 minutes", 1)
    assert found.select("cnt").first()[0] == 1
    found = cep.composed_windows(metrics, leaves, either, "4 minutes", "1 minute", 2)
    assert rows(found, "window_start", "cnt") == [(T0 - dt.timedelta(minutes=1), 2), (T0, 2)]


def chain(depth, seed):
    """An expression of `depth` alternating levels."""
    e = L(NAMES[seed % 4])
    for i in range(depth):
        side = L(NAMES[(seed + 3 * i) % 4])
        e = e & side if (i + seed) % 2 else e | side
    return e


def test_depth_20_folds_level_by_level(spark, tmp_path):
    known = {"a": True, "b": False, "c": True, "d": False}
    rules = [(f"r{i}", chain(20, i)) for i in range(6)]
    cep.node_frame(spark, *rules).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    found = cep.evaluate(nodes, spark.createDataFrame(list(known.items()), RESULTS))
    assert dict(map(tuple, found.collect())) == {name: strict(e, known) for name, e in rules}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 2 * cep.LEVELS_A_PLAN + 4
