import datetime as dt

import pytest
from conftest import METRICS, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsewatch.functions import times
from pulsewatch.operators import lookup, views
from pulsewatch.sources.rules import rules_frame

NOW = dt.datetime(2024, 1, 1, 12, 0, 0, 900000)


def at(**back):
    return NOW - dt.timedelta(**back)


@pytest.fixture
def metrics(make):
    return make(
        METRICS,
        [
            (at(seconds=10), 1, "s1", "cpu", 1.0),
            (at(seconds=10), 3, "s1", "cpu", 3.0),
            (at(seconds=10), 2, "s1", "cpu", 2.0),
            (at(minutes=4), 9, "s1", "cpu", 9.0),
            (at(minutes=5, seconds=0.9), 4, "s2", "cpu", 4.0),
            (at(minutes=6), 5, "s3", "cpu", 5.0),
            (at(seconds=20), 6, "s1", "mem", None),
        ],
    )


def test_latest_breaks_ties_by_sequence(metrics):
    assert rows(views.latest(metrics), "resource", "metric", "value", "seq") == [
        ("s1", "cpu", 3.0, 3),
        ("s1", "mem", None, 6),
        ("s2", "cpu", 4.0, 4),
        ("s3", "cpu", 5.0, 5),
    ]


def test_retention_counts_whole_seconds(metrics):
    # 5 minutes and 0.9 s before 12:00:00.9 is second 11:55:00: a whole-second age of 300.
    kept = views.state_view(metrics, as_of=F.lit(NOW))
    assert rows(kept, "resource", "metric") == [("s1", "cpu"), ("s1", "mem"), ("s2", "cpu")]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.datetimes(dt.datetime(1, 1, 2), dt.datetime(9999, 12, 30)),
            st.integers(-(2**63), 2**63 - 1),
        ),
        min_size=2,
        max_size=12,
    )
)
def test_ordinal_sorts_like_time_then_sequence(spark, pairs):
    df = spark.createDataFrame(pairs, "ts timestamp_ntz, seq long")
    packed = [tuple(r) for r in df.orderBy(times.ordinal()).collect()]
    assert packed == sorted(pairs)


@pytest.mark.parametrize(
    "text, us",
    [("5 seconds", 5_000_000), ("1 minutes", 60_000_000), ("1 hour 30 minutes", 5_400_000_000), ("2 DAYS", 172_800_000_000)],
)
def test_durations(text, us):
    assert times.micros(text) == us


@pytest.mark.parametrize("text", ["", "soon", "5", "1 month", "5 seconds ago"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        times.micros(text)


def test_rollup(make):
    base = dt.datetime(2024, 1, 1)
    df = make(
        METRICS,
        [(base + dt.timedelta(seconds=s), i, "s", "cpu", v) for i, (s, v) in enumerate([(0, 1.0), (59, 3.0), (60, 5.0), (61, None)])],
    )
    found = rows(views.rollup(df), "window_start", "cnt", "mean", "min", "max", "stddev")
    assert found[0] == (base, 2, 2.0, 1.0, 3.0, pytest.approx(2**0.5))
    assert found[1] == (base + dt.timedelta(minutes=1), 1, 5.0, 5.0, 5.0, None)


def test_rollup_retention_is_by_window_start(make):
    base = dt.datetime(2024, 1, 1, 12)
    df = make(METRICS, [(base - dt.timedelta(minutes=m, seconds=1), m, "s", "cpu", 1.0) for m in range(40)])
    kept = views.rollup(df, minutes=30, as_of="2024-01-01 12:00:00")
    starts = [r["window_start"] for r in kept.collect()]
    assert min(starts) == base - dt.timedelta(minutes=30) and len(starts) == 30


def test_weighted_mean_and_its_default(make):
    w = "window_start timestamp, resource string, metric string, cnt long, mean double, min double, max double, stddev double"
    base = dt.datetime(2024, 1, 1, 12)
    rolled = make(
        w,
        [
            (base - dt.timedelta(minutes=1), "s", "cpu", 3, 10.0, 8.0, 12.0, 2.0),
            (base - dt.timedelta(minutes=2), "s", "cpu", 1, 30.0, 30.0, 30.0, None),
            (base - dt.timedelta(minutes=3), "s", "cpu", 0, None, None, None, None),
            (base - dt.timedelta(minutes=9), "s", "cpu", 5, 99.0, 99.0, 99.0, 0.0),
            (base - dt.timedelta(minutes=1), "s", "mem", 0, None, None, None, None),
        ],
    )
    now = "2024-01-01 12:00:00"
    assert lookup.rollup_mean_value(rolled, "s", "cpu", 5, now) == 15.0
    assert lookup.rollup_mean_value(rolled, "s", "mem", 5, now) == 0.0
    assert lookup.rollup_mean_value(rolled, "s", "disk", 5, now) == 0.0
    spark = rolled.sparkSession
    rules = rules_frame(
        spark,
        [
            {"rule_id": s, "resource": "s", "metric": "cpu", "summary": s, "op": op, "threshold": x}
            for s, op, x in [("mean", "=", 15.0), ("cnt", "=", 4.0), ("min", "=", 8.0), ("max", "=", 30.0), ("stddev", ">", 10.0)]
        ],
    )
    judged = lookup.rollup_rules(rolled, rules, 5, as_of=now)
    assert rows(judged, "rule_id", "detect") == [(s, True) for s in ("cnt", "max", "mean", "min", "stddev")]
    assert rows(judged, "total_cnt", "min_age", "max_age")[0] == (4, 60, 180)


def test_single_lookups(metrics, spark):
    state = views.latest(metrics)
    assert views.current_value(state, "s1", "cpu") == 3.0
    assert views.current_value(state, "s1", "disk") is None
    state.createOrReplaceTempView("state")
    assert views.current_value_sql(spark, "select value from state where resource = 's3'") == 5.0
    assert views.current_value_sql(spark, "select value from state where resource = 'x'") is None
    assert views.rule_holds(state, "value > 4") and not views.rule_holds(state, "value > 50")
    assert views.run_rule(state, "value >= 4", lambda df: df.count()) == 2


def test_views_are_shared_across_sessions(metrics, spark):
    metrics.createOrReplaceGlobalTempView("shared_metrics")
    assert spark.newSession().table("global_temp.shared_metrics").count() == 7


def test_orders(make):
    df = make("window_start timestamp, resource string, metric string", [(NOW, "b", "x"), (NOW, "a", "y"), (at(days=1), "z", "z")])
    assert [r.resource for r in views.sorted_rollups(df).collect()] == ["z", "a", "b"]
    assert [r.resource for r in views.newest_windows(df, 2).collect()] == ["a", "b"]
    assert [r.resource for r in views.sorted_state(df).collect()] == ["a", "b", "z"]


def test_latest_stays_a_hash_aggregate(metrics):
    plan = views.latest(metrics)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
