import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.functions.averages import register_user_avg, user_avg
from pulsewatch.operators import counts
from pulsewatch.operators.rulebook import current_rules
from pulsewatch.sources.rules import RuleBook, load_rules, rules_frame

T0 = dt.datetime(2024, 1, 1)
CHANGES = "rule_id string, resource string, metric string, op string, threshold double, updated_at timestamp, seq long"


def test_the_last_change_counts(make):
    changes = make(
        CHANGES,
        [
            ("1", "node-1", "mem.used_percent", ">", 50.0, T0, 1),
            ("1", "node-1", "mem.used_percent", ">", 80.0, T0, 2),
            ("2", "node-2", "mem.used_percent", ">", 60.0, T0 + dt.timedelta(days=1), 1),
            ("2", "node-2", "mem.used_percent", ">", 10.0, T0, 9),
        ],
    )
    assert rows(current_rules(changes), "rule_id", "threshold") == [("1", 80.0), ("2", 60.0)]


def test_rule_book(spark, tmp_path):
    book = RuleBook(spark, str(tmp_path / "rules"))
    book.put({"rule_id": "r1", "kind": "threshold", "resource": "s", "metric": "cpu", "op": ">", "threshold": 80.0})
    book.put(
        {"rule_id": "r2", "kind": "threshold", "resource": "s", "metric": "mem", "op": ">", "threshold": 90.0},
        {"rule_id": "c1", "kind": "continuous", "target_rule_id": "r1", "mark_count": 3},
    )
    assert rows(book.current(), "rule_id") == [("c1",), ("r1",), ("r2",)]
    assert rows(book.current("continuous"), "rule_id", "mark_count") == [("c1", 3)]
    assert rows(counts.rules_per_metric(book.current("threshold"))) == [("cpu", 1), ("mem", 1)]
    book.update({"rule_id": "r2", "kind": "threshold", "resource": "s", "metric": "mem", "op": "<", "threshold": 1.0})
    assert rows(book.current("threshold"), "rule_id", "op") == [("r1", ">"), ("r2", "<")]
    book.remove("r1")
    assert rows(book.current(), "rule_id") == [("c1",), ("r2",)]
    book.clear()
    assert book.current().count() == 0
    book.put({"rule_id": "r1", "kind": "log", "keyword": "x"})
    assert rows(book.current(), "rule_id", "kind") == [("r1", "log")]
    assert book.history().count() == 8


def test_one_call_can_change_a_rule_twice(spark, tmp_path):
    book = RuleBook(spark, str(tmp_path / "rules"))
    book.put({"rule_id": "r", "threshold": 1.0}, {"rule_id": "r", "threshold": 2.0})
    assert rows(book.current(), "threshold") == [(2.0,)]


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        rules_frame(spark, [{"rule": "r"}])


def test_rules_from_a_store_of_json(spark, tmp_path):
    texts = [
        json.dumps({"resource": "s1", "metric": "cpu", "value": 80, "op": "<"}),
        json.dumps({"resource": "s1", "metric": "mem", "value": 70, "extra": 1}),
        "junk",
    ]
    spark.createDataFrame([(t,) for t in texts], "value string").write.parquet(str(tmp_path / "store"))
    found = load_rules(spark, str(tmp_path / "store"), json_column="value")
    assert rows(found) == [("s1:cpu", "s1", "cpu", "<", 80.0), ("s1:mem", "s1", "mem", ">", 70.0)]
    rules_frame(spark, [{"rule_id": "a", "threshold": 1.0}]).write.json(str(tmp_path / "json"))
    assert rows(load_rules(spark, str(tmp_path / "json"), "json"), "rule_id", "threshold") == [("a", 1.0)]


def test_user_average(make, spark):
    df = make("k string, value int", [("a", 12), ("a", 11), ("a", 1), ("a", 0), ("b", None), (None, 3)])
    assert rows(user_avg(df, ["k"], "value")) == sorted([("a", 6.0), ("b", None), (None, 3.0)], key=repr)
    assert rows(user_avg(df.where("k = 'a'"), [], "value")) == [(6.0,)]
    register_user_avg(spark)
    df.where("k = 'a'").createOrReplaceTempView("four")
    assert spark.sql("select user_avg(value) from four").first()[0] == 6.0


def test_counts(make):
    checks = make("day int, metric string, chk int", [(1, "m", 1), (1, "m", 0), (1, "n", 1), (2, "m", 1)])
    assert rows(counts.detect_counts(checks)) == [("m", 0, 1), ("m", 1, 2), ("n", 1, 1)]
    daily = counts.batch_counts(checks, "day")
    assert rows(daily) == [(1, "m", 1, 1, 2), (1, "n", 0, 1, 1), (2, "m", 0, 1, 1)]
    for limit in (100, 1):
        total = counts.running_counts(daily, "day", limit)
        assert rows(total, "day", "metric", "total_count") == [(1, "m", 3), (1, "n", 3), (2, "m", 4)]


def test_rows_per_partition(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("no"), "id")
    found = counts.partition_rows(df, 4, "no")
    assert found.agg(F.sum("cnt")).first()[0] == 100
    assert all(r["cnt"] % 10 == 0 for r in found.collect())
