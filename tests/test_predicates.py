import pytest
from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.functions import predicates as p


@pytest.mark.parametrize(
    "op, expected",
    [
        ("=", [False, True, False]),
        (">", [False, False, True]),
        (">=", [False, True, True]),
        ("<", [True, False, False]),
        ("<=", [True, True, False]),
        ("!=", [True, False, True]),
        ("<>", [True, False, True]),
        ("~", [False, False, False]),
        (None, [False, False, False]),
    ],
)
def test_every_operator(make, op, expected):
    df = make("i int, v double", [(0, 1.0), (1, 2.0), (2, 3.0), (3, None)])
    held = df.orderBy("i").select(p.compare(F.col("v"), F.lit(op).cast("string"), F.lit(2.0)))
    assert [r[0] for r in held.collect()] == [*expected, False]


def test_missing_stays_missing_where_asked(make):
    df = make("v double, op string", [(None, ">"), (1.0, "~"), (1.0, ">")])
    assert rows(df.select(p.compare_or_null(F.col("v"), F.col("op"), 0.0))) == [(None,), (None,), (True,)]


def test_nan_is_above_every_number(make):
    df = make("v double", [(float("nan"),)])
    assert df.select(p.compare(F.col("v"), ">", 1e300)).first()[0]


def test_key_condition_matches_only_its_own_metric(make):
    df = make("resource string, metric string, value double", [("s", "cpu", 9.0), ("s", "mem", 9.0)])
    assert rows(df.where(p.key_match("s", "cpu")), "metric") == [("cpu",)]
    assert rows(df.where(p.threshold_condition("s", "mem", ">", 5.0)), "metric") == [("mem",)]


def test_quotes_in_a_rule_are_only_text(make):
    df = make("resource string, metric string", [("it's' OR 1=1 --", "m"), ("x", "m")])
    assert df.where(p.key_match("it's' OR 1=1 --", "m")).count() == 1


def test_groups_nest_and_grow(make):
    df = make("a int", [(i,) for i in range(6)])
    group = p.FilterGroup("OR", (F.col("a") == 1,)).add(F.col("a") == 2).add(
        p.FilterGroup("AND", (p.raw_condition("a > 3"), F.col("a") < 5))
    )
    assert rows(df.where(group.condition())) == [(1,), (2,), (4,)]
    assert df.where(p.FilterGroup("OR").condition()).count() == 0
    with pytest.raises(ValueError):
        p.FilterGroup("XOR", (F.col("a") == 1,)).condition()


def test_log_keywords_are_literal(make):
    df = make("log string", [("an ERROR here",), ("ERROR",), ("100%",), (None,)])
    assert rows(df.where(p.log_condition("", "like", "x"))) == []
    assert df.where(p.log_condition(F.col("log"), "=", "ERROR")).count() == 1
    assert df.where(p.log_condition(F.col("log"), "!=", "ERROR")).count() == 2
    assert df.where(p.log_condition(F.col("log"), "like", "ERROR")).count() == 2
    assert rows(df.where(p.log_condition(F.col("log"), "like", "%"))) == [("100%",)]


def test_rollup_condition(make):
    df = make(
        "resource string, metric string, mean double, min double, max double, cnt long, stddev double",
        [("s", "cpu", 60.0, 1.0, 99.0, 3, None)],
    )
    assert df.where(p.rollup_condition("s", "cpu", "mean", ">", 50.0)).count() == 1
    assert df.where(p.rollup_condition("s", "cpu", "cnt", "=", 3.0)).count() == 1
    assert df.where(p.rollup_condition("s", "cpu", "stddev", ">=", 0.0)).count() == 0
    assert df.where(p.rollup_condition("s", "cpu", "median", ">=", 0.0)).count() == 0
