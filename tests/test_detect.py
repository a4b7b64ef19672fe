import datetime as dt
import json

import pytest
from conftest import METRICS, RULES, rows
from pyspark.sql import functions as F

from pulsewatch.functions.encode import encode_alarm
from pulsewatch.operators import detect, sizing
from pulsewatch.sources.rules import rules_frame

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def metrics(make):
    data = [
        (T0 + dt.timedelta(seconds=i), i, r, m, v)
        for i, (r, m, v) in enumerate(
            [
                ("s1", "cpu", 10.0),
                ("s1", "cpu", 90.0),
                ("s1", "mem", 50.0),
                ("s2", "cpu", 70.0),
                (None, "cpu", 70.0),
                ("s1", "cpu", None),
            ]
        )
    ]
    return make(METRICS, data)


@pytest.fixture
def rules(make):
    return make(
        RULES,
        [
            ("r1", "s1", "cpu", ">", 80.0),
            ("r2", "s1", "cpu", "<=", 10.0),
            ("r3", "s2", "cpu", "!=", 70.0),
            ("r4", "s9", "cpu", ">", 0.0),
        ],
    )


@pytest.fixture(params=["broadcast", "salted"])
def plan(request, monkeypatch):
    """Run with small sides broadcast, and again with every join shuffled and salted."""
    if request.param == "salted":
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(sizing, "HOT_ROWS", 1)


def test_each_rule_is_judged_on_its_own(metrics, rules, plan):
    assert rows(detect.detect(metrics, rules), "seq", "rule_id", "detect") == [
        (0, "r1", False),
        (0, "r2", True),
        (1, "r1", True),
        (1, "r2", False),
        (3, "r3", False),
        (5, "r1", False),
        (5, "r2", False),
    ]


def test_no_rules_give_no_rows(metrics, spark, plan):
    assert detect.detect(metrics, rules_frame(spark, [])).count() == 0
    assert detect.any_rule_matches(metrics, rules_frame(spark, [])).count() == 0


def test_rows_with_a_rule(metrics, rules, plan):
    assert rows(detect.has_rule(metrics, rules), "seq") == [(0,), (1,), (3,), (5,)]


def test_rows_some_rule_holds_for_come_once(metrics, rules, make, plan):
    more = rules.unionByName(make(RULES, [("r5", "s1", "cpu", ">=", 10.0)]))
    assert rows(detect.any_rule_matches(metrics, more), "seq") == [(0,), (1,)]


def test_first_match_keeps_unmatched_rows(metrics, rules, make, plan):
    ordered = rules.withColumn("rule_order", F.lit(5)).unionByName(
        make(RULES + ", rule_order int", [("r0", "s1", "cpu", ">=", 10.0, 1)])
    )
    assert rows(detect.first_match(metrics, ordered), "seq", "id", "chk") == [
        (0, "r0", 1),
        (1, "r0", 1),
        (2, "", 0),
        (3, "", 0),
        (4, "", 0),
        (5, "", 0),
    ]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_the_plain_join(spark, how):
    big = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 0, None).otherwise(
            (F.col("id") % 40).cast("string")
        ).alias("k"),
        "id",
    )
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("none", 4)], "k string, x int")
    if how == "left_semi":
        small = small.select("k").distinct()
    expected = rows(big.join(small, ["k"], how))
    assert rows(sizing.salted_join(big, small, ["k"], how, hot_rows=100, salts=8)) == expected


def test_hot_keys_are_spread(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("k"), "id")
    big = big.unionByName(spark.range(10).select(F.lit("rare").alias("k"), "id"))
    left, right = sizing.salted_sides(
        big, spark.createDataFrame([("hot",), ("rare",)], "k string"), ["k"], hot_rows=1000, salts=16
    )
    per_salt = left.groupBy("k", "_salt").count().groupBy("k").agg(F.count("*"), F.max("count"))
    found = {k: (n, most) for k, n, most in rows(per_salt)}
    assert found["hot"][0] == 16 and found["hot"][1] < 200 and found["rare"] == (1, 10)
    assert rows(right.groupBy("k").count()) == [("hot", 16), ("rare", 1)]


def test_size_check_looks_at_rows_and_bytes(spark):
    assert sizing.fits_broadcast(spark.range(100), max_rows=100)
    assert not sizing.fits_broadcast(spark.range(101), max_rows=100)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert not sizing.fits_broadcast(wide, max_bytes=5000)


def test_last_rule_of_a_key_wins(make):
    rules = make(
        RULES + ", updated_at timestamp, seq long",
        [
            ("a", "s", "m", ">", 1.0, T0, 1),
            ("b", "s", "m", "<", 2.0, T0, 2),
            ("c", "s", "m", "=", 3.0, T0 - dt.timedelta(days=1), 9),
        ],
    )
    assert rows(detect.last_rule_per_key(rules)) == [("s", "m", "b", "<", 2.0)]


def test_alarm_payload_nests_metric_and_rule(metrics, rules):
    alarm = (
        detect.simple_alarms(detect.detect(metrics, rules))
        .where("rule_id = 'r1' and detect")
        .select(encode_alarm().alias("v"))
        .first()["v"]
    )
    body = json.loads(alarm)
    assert body["alarmType"] == "simple" and body["occurCount"] == 1 and body["detect"] is True
    inner = json.loads(body["payload"])
    assert inner["metric"]["value"] == 90.0
    assert inner["rule"] == {"ruleId": "r1", "op": ">", "value": 80.0}


def test_log_rules_in_several_passes(make, spark):
    logs = make("seq long, resource string, log string", [(1, "a", "x ERROR"), (2, "b", "ok"), (3, None, "ERROR")])
    rules = rules_frame(
        spark,
        [
            {"rule_id": "l1", "op": "like", "keyword": "ERROR"},
            {"rule_id": "l2", "resource": "a", "op": "!=", "keyword": "ok"},
            {"rule_id": "l3", "resource": "b", "op": "=", "keyword": "ok"},
        ],
    )
    expected = [("l1", 1), ("l1", 3), ("l2", 1), ("l3", 2)]
    assert rows(detect.detect_logs(logs, rules), "rule_id", "seq") == expected
    assert rows(detect.detect_logs(logs, rules, spread=True, listed_rules=1), "rule_id", "seq") == expected
    assert detect.detect_logs(logs, rules_frame(spark, [])).count() == 0


def test_batch_verdicts(metrics, rules):
    found = detect.evaluate_batch(metrics, rules, F.lit(T0))
    assert found.columns == ["timestamp", "rule_id", "detect", "resource", "event", "value", "filter"]
    assert rows(found.where("rule_id = 'r1'"), "detect", "filter")[0] == (0, "cpu > 80.0")
