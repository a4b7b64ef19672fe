import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.functions.predicates import compare
from pulsewatch.operators import history, ordered, sizing

T0 = dt.datetime(2024, 1, 1)
ROWS = "ts timestamp, seq long, resource string, metric string, value double"
CHANGES = "rule_id string, resource string, metric string, op string, threshold double, updated_at timestamp, seq long, deleted boolean"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def tables(spark, seed, n=200, k=150):
    pick = random.Random(seed)
    key = lambda: (pick.choice(["hot", "hot", "b", None]), pick.choice(["m", "n"]))
    data = [(at(pick.choice([0.5, 1, 1, 60, 3600]) * pick.randint(0, 40)), i, *key(), pick.choice([1.0, 5.0, None])) for i in range(n)]
    changes = [
        (f"r{pick.randint(0, 12)}", *key(), pick.choice([">", "<", "=", "~"]), pick.choice([0.0, 3.0, None]), at(pick.choice([1, 60, 3600]) * pick.randint(0, 40)), i, pick.choice([True, False, False, None]))
        for i in range(k)
    ]
    return spark.createDataFrame(data, ROWS), spark.createDataFrame(changes, CHANGES)


def brute(data, changes):
    """Every row with every rule, by the last change of the rule that is not after the row."""
    met = data.alias("m").join(changes.withColumnRenamed("seq", "n").alias("c"), F.col("updated_at") <= F.col("ts"))
    columns = [F.col(f"m.{c}") for c in data.columns]
    last = met.groupBy(*columns, "rule_id").agg(F.max_by(F.struct("c.resource", "c.metric", "op", "threshold", "deleted"), F.struct("updated_at", "n")).alias("r"))
    kept = last.where("not coalesce(r.deleted, false) and r.resource = resource and r.metric = metric")
    judged = kept.withColumn("detect", compare(F.col("value"), F.col("r.op"), F.col("r.threshold")))
    return judged.select(*data.columns, "rule_id", "r.op", "r.threshold", "detect")


def test_rows_meet_the_rules_of_their_time(spark):
    for seed in range(3):
        data, changes = tables(spark, seed)
        assert rows(history.detect_as_of(data, changes)) == rows(brute(data, changes))


def test_hot_keys_and_hot_rules_are_split(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT_ROWS", 5)
    monkeypatch.setattr(ordered, "GROUP_ROWS", 20)
    data, changes = tables(spark, 7)
    assert rows(history.detect_as_of(data, changes)) == rows(brute(data, changes))


def test_what_meets_is_of_the_order_of_what_matches(spark):
    """A rule changed a thousand times beside one never changed: no row meets the whole history."""
    changes = [("often", "s", "m", ">", float(i), at(i), i, False) for i in range(1000)] + [("once", "s", "m", ">", 1.0, at(0), 5000, False)]
    data = [(at(i + 0.5), i, "s", "m", 10.0) for i in range(1000)]
    spans = history.validity(spark.createDataFrame(changes, CHANGES))
    assert spans.count() == 1001
    found = history.detect_as_of(spark.createDataFrame(data, ROWS), spark.createDataFrame(changes, CHANGES))
    assert found.count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_stretch" in plan


def test_empty_tables(spark):
    data, changes = tables(spark, 9, 5, 5)
    assert history.detect_as_of(data, changes.limit(0)).collect() == []
    assert history.detect_as_of(data.limit(0), changes).collect() == []


def test_tasks_are_sized_by_the_rows_that_ask(spark, monkeypatch):
    """A small table, past the rows of a task, is joined in more tasks than Spark's setting has."""
    monkeypatch.setattr(sizing, "TASK_ROWS", 20)
    data, changes = tables(spark, 3)
    found = history.detect_as_of(data, changes)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert rows(found) == rows(brute(data, changes))
