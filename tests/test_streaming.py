import datetime as dt
import os
import random
import signal
import subprocess
import sys
import time

import pytest
from conftest import METRICS, rows
from pyspark.sql import functions as F

from pulsewatch.operators import continuous, counts, views
from pulsewatch.operators import detect as rule
from pulsewatch.sources import messages, tables
from pulsewatch.sources.rules import RuleBook, rules_frame
from pulsewatch.streaming import live, streaks

T0 = dt.datetime(2024, 1, 1)
DETECTIONS = "rule_id string, occur_timestamp timestamp, seq long, detect boolean"


class Feed:
    """A folder of files, one per `send`, read as a stream one file per micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        os.makedirs(self.path)

    def send(self, data):
        self.spark.createDataFrame(data, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


def metric(second, seq, value, resource="s1", name="cpu"):
    return (T0 + dt.timedelta(seconds=second), seq, resource, name, value)


def threshold(name, value, op=">"):
    return {"rule_id": name, "kind": "threshold", "resource": "s1", "metric": "cpu", "op": op, "threshold": value}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in", METRICS)


def test_a_changed_rule_takes_effect_without_a_restart(spark, feed, tmp_path):
    book = RuleBook(spark, str(tmp_path / "rules"))
    book.put(threshold("r1", 50.0))
    out = str(tmp_path / "alarms")
    query = live.start_detection(feed.stream(), book.current, out, str(tmp_path / "cp"))
    try:
        feed.send([metric(0, 1, 60.0)])
        query.processAllAvailable()
        book.update(threshold("r1", 70.0))
        book.add(threshold("r2", 10.0))
        feed.send([metric(1, 2, 60.0)])
        query.processAllAvailable()
        book.remove("r1")
        feed.send([metric(2, 3, 60.0)])
        query.processAllAvailable()
    finally:
        query.stop()
    found = tables.read_batches(spark, out, live.ALARMS)
    assert rows(found, "seq", "rule_id", "detect") == [
        (1, "r1", True), (2, "r1", False), (2, "r2", True), (3, "r2", True),
    ]


def test_rules_learned_from_one_stream_are_used_by_another(spark, feed, tmp_path):
    changes = Feed(
        spark,
        tmp_path / "changes",
        "rule_id string, resource string, metric string, op string, threshold double, updated_at timestamp, seq long",
    )
    learned = live.rule_change_table(spark, str(tmp_path / "learned"))
    static = rules_frame(spark, [threshold("r1", 50.0)])

    def learn(*rows_):
        changes.send(list(rows_))
        live.start_rule_changes(changes.stream(), learned, str(tmp_path / "cp1"), available_now=True).awaitTermination()

    out = str(tmp_path / "alarms")
    both = lambda: rule.both_rule_sets(static, learned.read())
    query = live.start_detection(feed.stream(), both, out, str(tmp_path / "cp2"))
    try:
        for second, limit in enumerate([None, 40.0, 80.0]):
            if limit is not None:
                learn(("d1", "s1", "cpu", ">", limit, T0 + dt.timedelta(seconds=second), second))
            feed.send([metric(second, second, 60.0)])
            query.processAllAvailable()
    finally:
        query.stop()
    found = tables.read_batches(spark, out, live.ALARMS)
    assert rows(found, "seq", "rule_id", "detect") == [
        (0, "r1", True), (1, "d1", True), (1, "r1", True), (2, "d1", False), (2, "r1", True),
    ]


def test_stop_and_start_again_loses_and_repeats_nothing(spark, feed, tmp_path):
    rules = rules_frame(spark, [threshold("r1", 50.0)])
    out, cp = str(tmp_path / "alarms"), str(tmp_path / "cp")
    for i in range(4):
        feed.send([metric(i, i, 10.0 * i)])
        query = live.start_detection(feed.stream(), lambda: rules, out, cp, available_now=True)
        query.awaitTermination()
        if i == 1:
            feed.send([metric(100, 100, 99.0)])
    found = tables.read_batches(spark, out, live.ALARMS)
    assert rows(found, "seq") == [(0,), (1,), (100,), (2,), (3,)]


def scattered(n, seed):
    rnd = random.Random(seed)
    return [
        metric(rnd.randrange(3600), i, rnd.choice([None, rnd.uniform(0, 100)]), rnd.choice(["s1", "s2", None]))
        for i in range(n)
    ]


def test_views_equal_one_batch_over_all_rows_late_ones_too(spark, feed, tmp_path):
    data = scattered(300, 2)
    for i in range(0, 300, 100):
        feed.send(data[i : i + 100])
    state = live.state_table(spark, str(tmp_path / "state"))
    rolled = live.rollup_table(spark, str(tmp_path / "rollups"))
    state.lease = rolled.lease = 0  # readers of this test need no folder for long
    live.start_state_view(feed.stream(), state, str(tmp_path / "cp1"), available_now=True).awaitTermination()
    live.start_rollup_view(
        feed.stream(), rolled, str(tmp_path / "cp2"), "10 minutes", available_now=True
    ).awaitTermination()

    def check():
        assert rows(state.read().select("resource", "metric", "value", "ts", "seq")) == rows(
            views.latest(feed.batch())
        )
        names = ["window_start", "window_end", "resource", "metric", "cnt", "min", "max"]
        fine = [F.round("mean", 6), F.round("stddev", 6)]
        assert rows(rolled.read().select(*names, *fine)) == rows(
            views.rollup(feed.batch(), "10 minutes").select(*names, *fine)
        )

    check()
    assert state.compact() == rolled.compact() == 2
    check()
    feed.send(scattered(50, 9))
    live.start_state_view(feed.stream(), state, str(tmp_path / "cp1"), available_now=True).awaitTermination()
    live.start_rollup_view(
        feed.stream(), rolled, str(tmp_path / "cp2"), "10 minutes", available_now=True
    ).awaitTermination()
    check()
    assert state.compact() == 3 and state.compact() == 3
    rolled.compact()
    check()
    before = state.read()
    state.clean()
    rolled.clean()
    check()
    assert before.count() == state.read().count()
    assert os.listdir(tmp_path / "state" / "delta") == ["batch_id=3"]
    assert sorted(os.listdir(tmp_path / "state" / "base")) == ["upto=2", "upto=3"]


def test_a_batch_tried_twice_counts_once(spark, tmp_path, make):
    table = live.rollup_table(spark, str(tmp_path / "t"))
    part = make(
        "window_start timestamp, window_end timestamp, resource string, metric string, "
        "cnt long, mean double, m2 double, min double, max double",
        [(T0, T0, "s", "m", 2, 3.0, 2.0, 2.0, 4.0)],
    )
    assert table.read().count() == 0
    table.write(part, 0)
    table.write(part, 0)
    table.write(part, 1)
    assert rows(table.read(), "cnt", "mean") == [(4, 3.0)]


def test_closed_windows_are_emitted_once_and_late_rows_dropped(spark, feed, tmp_path):
    """The late-row bound follows one batch behind the rows that raised it."""
    base = str(tmp_path)
    closed = live.closed_rollups(feed.stream(), "1 minute", "70 seconds")
    query = live.start_table(closed, f"{base}/out", f"{base}/cp")
    try:
        for second, seq in [(5, 1), (30, 2), (600, 3), (10, 4), (900, 5), (20, 6), (1200, 7)]:
            feed.send([metric(second, seq, float(seq))])
            query.processAllAvailable()
    finally:
        query.stop()
    found = spark.read.parquet(f"{base}/out")
    first = found.where(F.col("window_start") == F.lit(T0))
    assert first.count() == 1 and first.first()["cnt"] in (2, 3)
    assert found.groupBy("window_start", "resource", "metric").count().where("count > 1").count() == 0
    assert found.agg(F.max("max")).first()[0] < 7


def test_window_alarm_and_last_value_streams(spark, feed, tmp_path):
    feed.send([metric(s, i, float(s)) for i, s in enumerate([1, 2, 3, 11, 12])])
    feed.send([metric(500, 99, 1.0)])
    base = str(tmp_path)
    last = live.last_in_window(feed.stream(), "10 seconds", "20 seconds")
    live.start_table(last, f"{base}/last", f"{base}/cp1", available_now=True).awaitTermination()
    assert rows(spark.read.parquet(f"{base}/last"), "value") == [(12.0,), (3.0,)]
    alarm = live.window_alarms(feed.stream(), F.col("value") > 1, "10 seconds", "5 seconds", 2)
    feed.send([metric(600, 100, 5.0)])
    live.start_table(alarm, f"{base}/alarm", f"{base}/cp2", available_now=True).awaitTermination()
    found = spark.read.parquet(f"{base}/alarm")
    offsets = [(int((r.window_start - T0).total_seconds()), r["cnt"]) for r in found.collect()]
    assert sorted(offsets) == [(-5, 2), (0, 2), (5, 2), (10, 2)]


def test_count_stream(spark, feed, tmp_path):
    rules = rules_frame(spark, [threshold("r1", 1.5)])
    for i in range(3):
        feed.send([metric(i, 10 * i + j, float(j)) for j in range(4)])
    out = str(tmp_path / "counts")
    live.start_counts(feed.stream(), lambda: rules, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    total = counts.running_counts(tables.read_batches(spark, out, live.COUNTS), "batch_id")
    assert rows(total, "batch_id", "metric", "not_detected", "detected", "batch_count", "total_count") == [
        (0, "cpu", 2, 2, 4, 4), (1, "cpu", 2, 2, 4, 8), (2, "cpu", 2, 2, 4, 12),
    ]


def test_verdict_stream(spark, feed, tmp_path):
    rules = rules_frame(spark, [threshold("r1", 1.5), threshold("r2", 1.0, "<")])
    feed.send([metric(0, 1, 2.0), metric(0, 2, 0.0, "s2")])
    out = str(tmp_path / "verdicts")
    live.start_rule_verdicts(feed.stream(), lambda: rules, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert rows(spark.read.parquet(out), "rule_id", "detect", "filter") == [("r1", 1, "cpu > 1.5"), ("r2", 0, "cpu < 1.0")]


def test_all_queries_on_one_source(spark, feed, tmp_path):
    feed.send(scattered(60, 4))
    rules = rules_frame(spark, [threshold("r1", 50.0)])
    base = str(tmp_path / "base")
    queries = live.start_all(feed.stream(), lambda: rules, base, available_now=True)
    for query in queries.values():
        query.awaitTermination()
    assert set(queries) == {"detect", "continuous", "state_view", "rollup_view"}
    assert rows(live.state_table(spark, f"{base}/state_view").read(), "seq") == rows(views.latest(feed.batch()), "seq")
    alarms = tables.read_batches(spark, f"{base}/alarms", live.ALARMS)
    assert alarms.count() == rule.detect(feed.batch(), rules).count()
    assert live.rollup_table(spark, f"{base}/rollup_view").read().count() == views.rollup(feed.batch()).count()


def detection(second, seq, hit, name="r"):
    return (name, T0 + dt.timedelta(seconds=second), seq, hit)


def continuous_rules(spark, mark=3):
    return rules_frame(spark, [{"rule_id": "c1", "target_rule_id": "r", "mark_count": mark}])


def test_runs_go_on_across_batches_and_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", DETECTIONS)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        streaks.start_continuous_alarms(
            feed.stream(), lambda: continuous_rules(spark), out, cp, available_now=True
        ).awaitTermination()

    feed.send([detection(1, 1, True), detection(0, 0, True)])
    go()
    feed.send([detection(3, 3, True), detection(2, 2, True)])
    feed.send([detection(4, 4, False), detection(5, 5, True)])
    go()
    feed.send([detection(6, 6, True), detection(7, 7, True)])
    go()
    found = tables.read_batches(spark, out, live.ALARMS)
    assert rows(found, "seq", "occur_count") == [(2, 3), (3, 4), (7, 3)]
    whole = continuous.continuous_alarms(feed.batch(), continuous_rules(spark), ts="occur_timestamp")
    assert rows(whole, "seq", "occur_count") == rows(found, "seq", "occur_count")


def test_late_detections_are_set_aside_and_equal_ones_count(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", DETECTIONS)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    rules = rules_frame(spark, [{"rule_id": "c1", "target_rule_id": "r", "mark_count": 1}])
    feed.send([detection(0, 0, True), detection(5, 5, True), detection(5, 5, True)])
    feed.send([detection(3, 3, False), detection(5, 5, True), detection(6, 6, True)])
    streaks.start_continuous_alarms(feed.stream(), lambda: rules, out, cp, available_now=True).awaitTermination()
    found = tables.read_batches(spark, out, live.ALARMS)
    assert rows(found, "seq", "occur_count") == [(0, 1), (5, 2), (5, 3), (5, 4), (6, 5)]
    assert rows(tables.read_batches(spark, f"{out}-late", streaks.LATE), "seq", "detect") == [(3, False)]


def test_runs_do_not_depend_on_where_batches_end(spark):
    """Ties, several rules and hot ones: every way to cut the rows gives the runs of one batch."""
    rnd = random.Random(5)
    declared = "rule_id string, occur_timestamp timestamp, seq long, metric string, value double, detect boolean"
    data = sorted(
        (rnd.choice("ab"), T0 + dt.timedelta(seconds=s // 3), s // 4, rnd.choice("xy"), float(rnd.randrange(2)), rnd.random() < 0.7)
        for s in range(60)
    )
    data.sort(key=lambda r: (*r[1:5], r[5]))
    from pulsewatch.operators.continuous import ORDER, streak_rows

    whole = rows(streak_rows(spark.createDataFrame(data, declared), ORDER), "rule_id", *ORDER, "detect", "streak")
    for cuts, limit in (([20, 40], None), ([1, 2, 59], 5)):
        carry, got = spark.createDataFrame([], streaks.CARRY), []
        for low, high in zip([0, *cuts], [*cuts, 60]):
            counted, carry, late = streaks.carried_streaks(spark.createDataFrame(data[low:high], declared), carry, limit)
            got += rows(counted, "rule_id", *ORDER, "detect", "streak")
            carry = spark.createDataFrame(carry.collect(), streaks.CARRY)
            assert late.count() == 0
        assert sorted(got, key=repr) == whole


def test_a_new_rule_book_has_no_rules(spark, tmp_path):
    book = RuleBook(spark, str(tmp_path / "book"))
    assert book.current().count() == 0
    book.clear()
    assert book.current().count() == 0


def test_only_rules_of_their_kind_are_judged(spark, feed, tmp_path):
    feed.send([metric(0, 1, 60.0)])
    rules = rules_frame(
        spark,
        [threshold("r1", 50.0), {**threshold("r2", 50.0), "kind": "rollup"}, {**threshold("r3", 50.0), "kind": "threshold"}],
    )
    out = str(tmp_path / "alarms")
    live.start_detection(feed.stream(), lambda: rules, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert rows(tables.read_batches(spark, out, live.ALARMS), "rule_id") == [("r1",), ("r3",)]


def test_folding_leaves_out_what_has_expired(spark, feed, tmp_path):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    feed.send([metric(0, 1, 1.0)])
    feed.send([(now, 2, "s2", "cpu", 2.0)])
    view = live.state_table(spark, str(tmp_path / "view"))
    live.start_state_view(
        feed.stream(), view, str(tmp_path / "cp"), compact_every=2, retention="1 hour", available_now=True
    ).awaitTermination()
    assert rows(view.read(), "seq") == [(2,)]
    assert view._numbers("upto") == [1]


KILLED = """
import sys
sys.path.insert(0, {repo!r})
from pulsewatch.session import build_session
from pulsewatch.sources.rules import rules_frame
from pulsewatch.streaming import streaks
spark = build_session("killed", "local[2]", {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
                      "spark.checkpoint.dir": {shared!r}}})
stream = spark.readStream.schema({schema!r}).option("maxFilesPerTrigger", 1).parquet({path!r})
rules = lambda: rules_frame(spark, [{{"rule_id": "c1", "target_rule_id": "r", "mark_count": 3}}])
streaks.start_continuous_alarms(stream, rules, {out!r}, {cp!r}).awaitTermination()
"""


def test_a_killed_process_is_taken_over(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", DETECTIONS)
    rnd = random.Random(1)
    data = [detection(i, i, rnd.random() < 0.9) for i in range(80)]
    for i in range(0, 80, 10):
        feed.send(data[i : i + 10])
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    repo = os.path.abspath(os.path.join(os.path.dirname(__file__), ".."))
    script = KILLED.format(repo=repo, schema=DETECTIONS, path=feed.path, out=out, cp=cp, shared=str(tmp_path / "shared"))
    with open(tmp_path / "log", "w") as log:
        # Run from elsewhere: the child's workers cannot import the package.
        child = subprocess.Popen(
            [sys.executable, "-c", script], stdout=log, stderr=log, cwd=tmp_path, start_new_session=True
        )
        try:
            for _ in range(600):
                if os.path.exists(f"{out}/batch_id=2") or child.poll() is not None:
                    break
                time.sleep(0.1)
        finally:
            os.killpg(child.pid, signal.SIGKILL)
            child.wait()
    done = len(os.listdir(f"{cp}/commits"))
    assert os.path.exists(f"{out}/batch_id=2") and done < 2 * 8
    streaks.start_continuous_alarms(
        feed.stream(), lambda: continuous_rules(spark), out, cp, available_now=True
    ).awaitTermination()
    found = tables.read_batches(spark, out, live.ALARMS)
    whole = continuous.continuous_alarms(feed.batch(), continuous_rules(spark), ts="occur_timestamp")
    assert rows(found, "seq", "occur_count") == rows(whole, "seq", "occur_count")


def test_file_messages(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(T0, "k", "{}"), (T0, "k", "[]")], messages.MESSAGE).write.parquet(path)
    for stream in (True, False):
        df = messages.read_messages(spark, "parquet", path, stream=stream)
        assert df.columns == ["timestamp", "key", "value", "seq"] and df.isStreaming == stream
    assert messages.read_messages(spark, "parquet", path, stream=False).select("seq").distinct().count() == 2


def test_kafka_options():
    assert messages.kafka_options("h:1", "t", max_per_trigger=100000, fail_on_data_loss=False) == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "t",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "100000",
        "failOnDataLoss": "false",
    }
    assert messages.kafka_options("h:1", "t", "earliest", **{"groupIdPrefix": "g"})["groupIdPrefix"] == "g"


def test_console_and_memory(spark, feed, tmp_path, capfd):
    feed.send([metric(0, 1, 2.0)])
    live.print_console(feed.batch(), 5)
    query = live.print_console(feed.stream(), 5)
    query.processAllAvailable()
    query.stop()
    assert capfd.readouterr().out.count("2024-01-01 00:00:00") >= 1
    assert sum(p["numInputRows"] for p in query.recentProgress) == 1
    memory = live.start_memory(feed.stream(), "seen", str(tmp_path / "cp"))
    memory.processAllAvailable()
    memory.stop()
    assert spark.table("seen").count() == 1
