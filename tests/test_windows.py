import datetime as dt
import math
import random

import pytest
from conftest import METRICS, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsewatch.operators import sizing, windows

T0 = dt.datetime(2024, 1, 1)


def sample(n, seed, spread=7200, base=0.0):
    rnd = random.Random(seed)
    return [
        (
            T0 + dt.timedelta(seconds=rnd.randrange(spread) - spread // 2),
            i,
            rnd.choice(["a", "b", None]),
            "m",
            rnd.choice([None, base + rnd.uniform(-50, 50), base + 1.0]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("size, slide", [("60 seconds", "20 seconds"), ("7 seconds", "5 seconds"), ("1 minute", None), ("50 seconds", "20 seconds")])
def test_panes_give_the_same_windows(make, size, slide):
    df = make(METRICS, sample(400, 1, 600)).where("value is not null")
    direct = (
        df.groupBy(F.window("ts", size, slide).alias("w"), "resource")
        .agg(F.count("*"), F.round(F.sum("value"), 6))
        .select("w.start", "w.end", "resource", "count(1)", F.col("round(sum(value), 6)"))
    )
    summed = windows.sliding_sums(df, size, slide, ["resource"], "value")
    assert rows(summed.withColumn("total", F.round("total", 6))) == rows(direct)


def test_window_alarm_needs_its_mark(make):
    df = make(METRICS, [(T0 + dt.timedelta(seconds=s), s, "a", "m", 9.0) for s in (0, 1, 2, 65)])
    found = windows.window_alarms(df, F.col("value") > 5, "1 minute", mark_count=3)
    assert rows(found, "window_start", "cnt") == [(T0, 3)]


def framed(df, span):
    """The same by a plain RANGE frame."""
    micros = int(span.total_seconds() * 1_000_000)
    spec = Window.partitionBy("resource", "metric").orderBy(F.unix_micros("ts")).rangeBetween(-micros, 0)
    stats = {"cnt": F.count("value"), "mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "stddev": F.stddev_pop("value")}
    return df.select("*", *[c.over(spec).alias(n) for n, c in stats.items()])


def agree(found, wanted, rel=1e-6):
    order = lambda r: (repr(r["resource"]), r["ts"], r["seq"])
    found, wanted = sorted(found.collect(), key=order), sorted(wanted.collect(), key=order)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert tuple(a)[:6] == tuple(b)[:6] or a["value"] != a["value"]
        for name in ("mean", "min", "max", "stddev"):
            assert (a[name] is None) == (b[name] is None)
            if a[name] is not None:
                assert a[name] == pytest.approx(b[name], nan_ok=True, rel=rel, abs=1e-6), (name, a, b)


@pytest.mark.parametrize("parts", [1, 2, 5, 7, 12])
@pytest.mark.parametrize("base", [0.0, 1e9])
def test_trailing_range_equals_a_range_frame(make, parts, base):
    df = make(METRICS, sample(500, 7, 7200, base))
    agree(windows.trailing_stats(df, "10 minutes", parts=parts), framed(df, dt.timedelta(minutes=10)))


@pytest.mark.parametrize("span", [dt.timedelta(microseconds=5), dt.timedelta(seconds=7, microseconds=1), dt.timedelta(minutes=12)])
def test_trailing_range_of_any_span(make, span):
    df = make(METRICS, sample(300, 3, 900))
    agree(windows.trailing_stats(df, f"{int(span.total_seconds() * 1e6)} microseconds"), framed(df, span))


def test_tasks_of_trailing_ranges_are_sized_by_rows(make, monkeypatch):
    """Rows that compress to next to nothing are not put together into one task."""
    monkeypatch.setattr(sizing, "TASK_ROWS", 50)
    df = make(METRICS, sample(500, 7, 7200))
    found = windows.trailing_stats(df, "10 minutes")
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    agree(found, framed(df, dt.timedelta(minutes=10)))


@pytest.mark.parametrize("odd", [math.nan, math.inf, -math.inf])
def test_one_odd_value_stays_in_the_ranges_that_hold_it(make, odd):
    data = [(T0 + dt.timedelta(minutes=i), i, "a", "m", odd if i == 50 else float(i % 7)) for i in range(101)]
    df = make(METRICS, data)
    agree(windows.trailing_stats(df, "12 minutes"), framed(df, dt.timedelta(minutes=12)))


def test_a_step_of_the_level_leaves_no_trace(make):
    data = [(T0 + dt.timedelta(minutes=i), i, "a", "m", (1e12 if i >= 60 else 0.0) + i % 3) for i in range(120)]
    df = make(METRICS, data)
    # Near 1e12 a plain frame keeps three or four digits of a deviation itself.
    agree(windows.trailing_stats(df, "12 minutes"), framed(df, dt.timedelta(minutes=12)), rel=1e-3)


def test_trailing_ranges_can_be_joined_on_their_time(make):
    df = make(METRICS, sample(50, 9))
    found = windows.trailing_stats(df, "1 hour").join(df.select("ts").distinct(), "ts")
    assert found.count() == 50


def test_one_instant_with_many_rows(make):
    df = make(METRICS, [(T0, i, "a", "m", float(i % 10)) for i in range(1000)])
    found = windows.trailing_stats(df, "1 hour")
    assert set(rows(found, "cnt", "mean", "min", "max")) == {(1000, 4.5, 0.0, 9.0)} and found.count() == 1000


def test_range_stats(make):
    df = make(
        METRICS,
        [(T0 - dt.timedelta(seconds=s), s, "a", "m", v) for s, v in [(0, 1.0), (60, 3.0), (61, 99.0), (-1, 99.0), (5, None)]],
    )
    found = windows.range_stats(df, "1 minute", "2024-01-01 00:00:00")
    assert rows(found, "cnt", "min", "max", "mean", "stddev") == [(2, 1.0, 3.0, 2.0, 1.0)]


def test_joined_windows(make):
    df = make(
        METRICS,
        [
            (T0, 1, "a", "err", 9.0),
            (T0 + dt.timedelta(seconds=1), 2, "a", "err", 9.0),
            (T0 + dt.timedelta(seconds=2), 3, "a", "load", 1.0),
            (T0 + dt.timedelta(seconds=2), 4, "b", "load", 1.0),
            (T0 + dt.timedelta(seconds=70), 5, "a", "load", 1.0),
        ],
    )
    found = windows.window_join(df, F.col("metric") == "err", F.col("metric") == "load", "1 minute", mark_count=2)
    assert rows(found, "resource", "seq", "cnt") == [("a", 3, 2)]
