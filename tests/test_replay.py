import pytest
from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.operators import ordered
from pulsewatch.sources import replay
from pulsewatch.streaming import live

SCHEMA = "id long, part int"


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP_ROWS", 40)
    events = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 4).cast("int").alias("part"))
    return replay.write_log(events, f"{tmp_path}/log", "part", ["id"], file_rows=16), rows(events)


def expected(events, start):
    out = []
    for p in range(4):
        own = sorted(i for i, q in events if q == p)
        out += [(i, p, n) for n, i in enumerate(own) if n >= start.get(p, 0)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spec, start", [("earliest", {}), ('{"metric":{"0":5,"2":17}}', {0: 5, 2: 17}), ("latest", {p: 999 for p in range(4)})])
def test_a_batch_reads_from_an_offset(spark, log, spec, start):
    path, events = log
    assert rows(replay.read_log(spark, path, SCHEMA, spec)) == expected(events, start)


def run(spark, path, base, spec, most, until=None):
    found = replay.stream_log(spark, path, SCHEMA, f"{base}/checkpoint", spec, max_rows=most)
    query = live.start_table(found, f"{base}/out", f"{base}/checkpoint")
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def test_a_stream_takes_bounded_batches_and_goes_on(spark, log, tmp_path):
    path, events = log
    sizes = run(spark, path, tmp_path, '{"metric":{"0":30}}', 40)
    assert max(sizes) <= 40 and len(sizes) >= 3
    out = spark.read.schema(f"{SCHEMA}, offset long").parquet(f"{tmp_path}/out")
    assert rows(out) == expected(events, {0: 30})
    assert run(spark, path, tmp_path, "earliest", 40) == [], "a known checkpoint goes on from where it was"


def test_only_the_rows_between_are_read(log):
    path, events = log
    index = replay.index_of(path)
    assert sorted(index) == [0, 1, 2, 3] and len(index[0]) > 3
    some = replay.stretches(index, {"0": 20, "1": 0}, {"0": 23, "1": 2})
    assert sorted((s.first, s.until) for s in some) == [(0, 2), (20, 23)]
    assert sum(b.num_rows for s in some for b in replay.rows_of(s, ["id", "offset"])) == 5
