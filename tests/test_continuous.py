import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.operators import continuous, ordered
from pulsewatch.sources.rules import rules_frame

T0 = dt.datetime(2024, 1, 1)
DETECTIONS = "rule_id string, ts timestamp, seq long, detect boolean"


def run_of(make, rule, text, start=0):
    return make(
        DETECTIONS,
        [(rule, T0 + dt.timedelta(seconds=start + i), start + i, {"T": True, "F": False, "-": None}[c]) for i, c in enumerate(text)],
    )


def watch(spark, target, mark, rule="c1"):
    return rules_frame(spark, [{"rule_id": rule, "target_rule_id": target, "mark_count": mark}])


def test_golden_run(make, spark):
    found = continuous.continuous_alarms(run_of(make, "r", "TTTTFTTT"), watch(spark, "r", 3))
    assert rows(found, "seq", "occur_count") == [(2, 3), (3, 4), (7, 3)]
    first = found.orderBy("seq").first()
    assert (first.alarm_type, first.rule_id, first.detect) == ("continuous", "c1", True)
    assert first.payload == '{"rule":{"ruleId":"c1","targetRuleId":"r","markCount":3}}'


def test_time_counts_not_arrival(make, spark):
    shuffled = run_of(make, "r", "TTTTFTTT").orderBy(F.rand(3))
    assert rows(continuous.continuous_alarms(shuffled, watch(spark, "r", 3)), "seq") == [(2,), (3,), (7,)]


def test_missing_verdict_resets_and_others_are_ignored(make, spark):
    data = run_of(make, "r", "TT-TT").unionByName(run_of(make, "other", "TTTTT"))
    assert rows(continuous.continuous_alarms(data, watch(spark, "r", 2)), "seq") == [(1,), (4,)]


def test_a_mark_of_zero_fires_on_every_row(make, spark):
    found = continuous.continuous_alarms(run_of(make, "r", "TF"), watch(spark, "r", 0))
    assert rows(found, "seq", "occur_count") == [(0, 1), (1, 0)]


def test_rules_on_rules(make, spark):
    first = continuous.continuous_alarms(run_of(make, "r", "TTTTFTTT"), watch(spark, "r", 2))
    again = first.withColumnRenamed("occur_timestamp", "ts")
    second = continuous.continuous_alarms(again, watch(spark, "c1", 3, "c2"))
    assert rows(second, "rule_id", "seq", "occur_count") == [("c2", 3, 3), ("c2", 6, 4), ("c2", 7, 5)]


def many(spark, n=1200, seed=5):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        data.append((key, T0 + dt.timedelta(seconds=rnd.randrange(n)), i, rnd.random() < 0.93))
    return spark.createDataFrame(data, DETECTIONS).withColumn(
        "x", F.when(F.col("seq") % 3 == 0, F.col("seq") * 2)
    )


KEYS, ORDER = ["rule_id"], ["ts", "seq"]


@pytest.mark.parametrize("limit", [50, 400])
def test_split_groups_give_the_same_answers(spark, limit):
    df = many(spark)
    cases = [
        (ordered.streaks, ("detect",)),
        (ordered.running_sum, ("x", "out")),
        (ordered.previous, ("x", "out")),
        (ordered.last_known, ("x", "out")),
    ]
    for fn, args in cases:
        plain = fn(df, KEYS, ORDER, *args, limit=10**9)
        split = fn(df, KEYS, ORDER, *args, limit=limit)
        assert sorted(plain.columns) == sorted(split.columns)
        assert rows(split.select(plain.columns)) == rows(plain), fn.__name__


def test_long_runs_cross_many_slices(spark):
    df = spark.range(1000).select(
        F.lit("r").alias("rule_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), (F.col("id") != 17).alias("detect")
    )
    split = ordered.streaks(df, KEYS, ORDER, "detect", limit=50)
    assert split.agg(F.max("streak")).first()[0] == 982


def test_slices_are_bounded(spark):
    df = many(spark)
    cut, by, split = ordered.slices(df, KEYS, ORDER, limit=200)
    assert split and cut.groupBy(*by).count().agg(F.max("count")).first()[0] <= 400


def test_running_sum_without_keys(spark):
    df = spark.range(500).withColumn("v", F.lit(2))
    for limit in (10**9, 50):
        total = ordered.running_sum(df, [], ["id"], "v", "t", limit=limit)
        assert total.where("t != 2 * (id + 1)").count() == 0


def test_current_streak_is_the_last_one(spark):
    df = many(spark).where("rule_id is not null")
    last = continuous.streak_rows(df, ["ts", "seq"]).groupBy("rule_id").agg(F.max_by("streak", F.struct("ts", "seq")))
    assert rows(continuous.current_streaks(df)) == rows(last)


TIED = "rule_id string, ts timestamp, seq long, metric string, value double, detect boolean"


def test_current_streak_follows_the_order_of_alarms_on_ties(spark):
    rnd = random.Random(9)
    data = [
        (f"r{rnd.randrange(9)}", T0, rnd.randrange(3), rnd.choice(["m", "n", None]), rnd.choice([None, 1.0, 2.0]), rnd.random() < 0.8)
        for _ in range(400)
    ]
    df = spark.createDataFrame(data + [("one", T0, 0, "k", 1.0, False), ("one", T0, 0, "value", 1.0, True)], TIED)
    order = ["ts", "seq", "metric", "value"]
    held = F.col("detect").cast("int").alias("held")
    last = continuous.streak_rows(df, order).groupBy("rule_id").agg(F.max_by("streak", F.struct(*order, held, "streak")))
    found = continuous.current_streaks(df)
    assert rows(found) == rows(last)
    assert found.where("rule_id = 'one'").first().streak == 1
