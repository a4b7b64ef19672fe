import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.operators import continuous
from pulsewatch.plans import rule_queries
from pulsewatch.plans.tables import rule_rows
from pulsewatch.sources.tables import read_batches
from pulsewatch.streaming import keyed, live

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "rule_id string, detect boolean, occur_timestamp timestamp, seq long, metric string, value double"
WATCH = [{"rule_id": "c2", "target_rule_id": "r1", "mark_count": 2}, {"rule_id": "c1", "target_rule_id": "r2", "mark_count": 1}]
OUT = ["rule_id", "target_rule_id", "occur_count", "occur_timestamp", "seq", "metric", "value"]


def detections(seed, n=300, spread=40):
    """Rows with ties, and the order they arrive in: off by under `spread` seconds."""
    pick = random.Random(seed)
    data = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=i // 3)
        data.append((pick.choice(["r1", "r2", "r3"]), pick.random() < 0.8, at, pick.choice([i // 5, i // 5, None]), pick.choice(["a", "b", None]), pick.choice([None, 1.0, float("nan"), 2.0])))
    data += data[10:14]
    return data, sorted(data, key=lambda r: r[2] + dt.timedelta(seconds=pick.random() * (spread - 1)))


def feed(spark, arrived, base, cuts, number=0):
    for low, high in zip(cuts, cuts[1:]):
        spark.createDataFrame(arrived[low:high], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return keyed.start_continuous_state(
        files, lambda: rule_rows(spark, WATCH), f"{base}/alarms", f"{base}/checkpoint", "40 seconds", available_now=True
    )


def told(df):
    """Rows with NaN as a text, so that they compare."""
    return sorted(tuple(map(repr, r)) for r in rows(df, *OUT))


def expected(spark, data):
    whole = spark.createDataFrame(data, SCHEMA).withColumnRenamed("occur_timestamp", "ts")
    passed = max(r[2] for r in data) - dt.timedelta(seconds=40)
    alarms = continuous.continuous_alarms(whole, rule_rows(spark, WATCH))
    return told(alarms.where(alarms.occur_timestamp <= passed))


def found(spark, base):
    return told(read_batches(spark, f"{base}/alarms", live.ALARMS))


@pytest.mark.parametrize("cuts", [[0, 304], [0, 9, 130, 131, 250, 304]])
def test_however_batches_are_cut(spark, tmp_path, cuts):
    data, arrived = detections(1)
    feed(spark, arrived, tmp_path, cuts).awaitTermination()
    assert found(spark, tmp_path) == expected(spark, data)


def test_state_comes_back_after_a_restart(spark, tmp_path):
    data, arrived = detections(2)
    feed(spark, arrived, tmp_path, [0, 60, 150]).awaitTermination()
    feed(spark, arrived, tmp_path, [150, 200, 304]).awaitTermination()
    assert found(spark, tmp_path) == expected(spark, data)


def test_idle_rules_are_forgotten(spark, tmp_path):
    seconds = [0, 1, 2, 100, 200, 201, 400, 401]
    data = [("r1", True, T0 + dt.timedelta(seconds=s), s, "m", 1.0) for s in seconds]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    for part in (data[:3], data[3:4], data[4:6], data[6:], [("x", True, T0 + dt.timedelta(seconds=900), 0, "m", 1.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        files = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        runs = keyed.ordered_runs(files, "10 seconds", idle="150 seconds")
        live.start_table(runs, f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "seq", "streak")
    assert sorted(got) == [(0, 1), (1, 2), (2, 3), (100, 4), (200, 5), (201, 6), (400, 1), (401, 2)]


def test_order_of_nulls_and_nans():
    values = [2.0, float("nan"), None, -1.0]
    assert sorted(values, key=keyed.null_first)[:3] == [None, -1.0, 2.0]


class Held:
    """State of one key in memory: a list, or one value."""

    def __init__(self):
        self.rows = []

    def appendValue(self, row):
        self.rows.append(row)

    def update(self, row):
        self.rows = [row]

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class HeldList(Held):
    def get(self):
        return iter(self.rows)


class HeldValue(Held):
    def get(self):
        return self.rows[0]


class Handle:
    def __init__(self):
        self.list, self.value, self.timers = HeldList(), HeldValue(), []
        self.getListState, self.getValueState = lambda *_: self.list, lambda *_: self.value
        self.registerTimer = self.timers.append


class Passed:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_rows_wait_in_packs():
    """State is read and written by thousands of rows, not one by one, and nothing is lost in them."""
    n, handle, runs = 25_000, Handle(), keyed.OrderedRuns()
    runs.init(handle)
    order = np.random.default_rng(1).permutation(n)
    arrived = pd.DataFrame(
        {"at": order * 1000, "has_seq": order % 3 > 0, "seq": order, "metric": [None if i % 5 == 0 else "m" for i in order.tolist()],
         "kind": order % 3, "value": 0.0, "detect": order % 10 > 0}
    )
    runs.handleInputRows(("r",), iter([arrived[:12_000], arrived[12_000:]]), None)
    assert len(handle.list.rows) <= 5 and handle.timers == [0]
    first = pd.concat(runs.handleExpiredTimer(("r",), Passed(17_000), None))
    assert len(handle.list.rows) == 1 and handle.timers == [0, 17_001]
    rest = pd.concat(runs.handleExpiredTimer(("r",), Passed(n), None))
    assert not handle.list.rows and handle.value.get() == (9, (n - 1) * 1000)
    out = pd.concat([first, rest])
    assert out["seq"].tolist() == list(range(n)) and len(first) == 17_001
    assert out["streak"].tolist() == [i % 10 for i in range(n)]
    assert out["metric"].isna().tolist() == [i % 5 == 0 for i in range(n)]


@pytest.mark.parametrize("idle", [None, 3])
def test_run_lengths_equal_those_row_by_row(idle):
    pick = random.Random(3)
    for _ in range(50):
        at = sorted(pick.randint(10, 60) for _ in range(pick.randint(1, 30)))
        detect = [pick.random() < 0.8 for _ in at]
        length, last = pick.randint(0, 4), pick.randint(5, 10)
        run, before, expect = length, last, []
        for t, held in zip(at, detect):
            run = (0 if idle is not None and t - before > idle else run) + 1 if held else 0
            before = t
            expect.append(run)
        assert keyed.run_lengths(np.array(detect), np.array(at), length, last, idle).tolist() == expect


def test_micro_batches_of_several_files(spark, tmp_path, monkeypatch):
    """Large pieces are written by several tasks, and a micro-batch still holds just its piece."""
    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # Ids that differ in few places: some tasks have no rows.
    few = whole.withColumn("event_id", (F.col("event_id") % 3).cast("long"))
    few.write.parquet(f"{tmp_path}/few/events.parquet")
    for name, sf_dir in (("plain", "/root/testdata/sf0.001"), ("few", f"{tmp_path}/few")):
        found = {}
        for size in (1_000_000, max(1, whole.count() // 30)):
            monkeypatch.setattr(rule_queries, "FILE_ROWS", size)
            base, seen = f"{tmp_path}/{name}-{size}", {}
            stream = rule_queries.shuffled_event_files(spark, sf_dir, base)
            handle = lambda batch, n: seen.setdefault(n, sorted(map(str, batch.collect())))
            live.per_batch(stream, handle, f"{base}/checkpoint", available_now=True).awaitTermination()
            found[size] = seen, len(spark.read.parquet(f"{base}/events").inputFiles())
        (one, files), (several, more) = found.values()
        assert files == 5 and more == 5 * 7
        assert one == several and sum(map(len, one.values())) == whole.count()
