import datetime as dt

import pytest
from conftest import rows

from pulsewatch import schema
from pulsewatch.operators import progress
from pulsewatch.streaming.listener import ProgressRecorder, read_progress

T0 = dt.datetime(2024, 1, 1)


def minute(m):
    return T0 + dt.timedelta(minutes=m)


@pytest.fixture
def entries(make):
    return make(
        schema.PROGRESS,
        [("q", i, minute(10 * i), f'{{"t":{{"0":{i * 5}}}}}') for i in range(1, 5)] + [("single", 1, minute(10), "o")],
    )


ASKED = [(5, 5), (10, 5), (15, 5), (20, 5), (21, 10), (40, 15), (41, None)]


@pytest.mark.parametrize("m, offset", ASKED)
def test_offset_at_a_time(entries, m, offset):
    expected = None if offset is None else f'{{"t":{{"0":{offset}}}}}'
    assert progress.offset_at(entries, "q", str(minute(m))) == expected


@pytest.mark.parametrize("limit", [10**9, 3])
def test_many_at_once(entries, make, limit):
    asked = make("query string, ts timestamp", [("q", minute(m)) for m, _ in ASKED] + [("single", minute(5)), ("none", T0)])
    found = progress.offsets_as_of(entries, asked, limit)
    expected = [("q", minute(m), None if o is None else f'{{"t":{{"0":{o}}}}}') for m, o in ASKED]
    assert rows(found) == sorted([*expected, ("single", minute(5), None), ("none", T0, None)], key=repr)


def test_repeats_and_empty_offsets_are_left_out(make):
    offsets = [None, "a", "a", "None", "a", "b", "null", "a"]
    df = make(schema.PROGRESS, [("q", i, minute(i), o) for i, o in enumerate(offsets)])
    for limit in (10**9, 2):
        assert rows(progress.changes_only(df, limit), "batch_id", "start_offset") == [(1, "a"), (5, "b"), (7, "a")]


def test_last_offset(entries):
    assert rows(progress.last_offset(entries)) == [("q", '{"t":{"0":20}}'), ("single", "o")]


def test_batches_are_ordered_as_numbers(make):
    df = make(schema.PROGRESS, [("q", i, minute(i), "o") for i in (8, 9, 10, 11)])
    assert rows(progress.batches_since(df, str(minute(9))), "batch_id") == [(10,), (11,), (9,)]
    assert progress.batches_since(df, str(minute(12))).count() == 0


def test_replay_start(entries):
    opts = lambda spec: progress.replay_options(spec, entries, "q")["startingOffsets"]
    assert opts("earliest") == "earliest" and opts("latest") == "latest"
    assert opts('{"readings":{"0":7,"3":140}}') == '{"readings":{"0":7,"3":140}}'
    assert opts("2024-01-01 00:25:00") == '{"t":{"0":10}}'
    millis = int(minute(25).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert opts(millis) == '{"t":{"0":10}}'
    for bad in ("yesterday", "2024-01-01 09:00:00", "{not json}"):
        with pytest.raises(ValueError):
            opts(bad)


def test_history_text(entries):
    lines = entries.where("query = 'q'").select(progress.history_line().alias("value"))
    first = lines.orderBy("value").first()["value"]
    assert first == '1704067800000#2024-01-01 00:10:00#{"t":{"0":5}}'
    again = progress.parse_history(lines, "q")
    assert rows(again, "ts", "start_offset") == rows(entries.where("query = 'q'"), "ts", "start_offset")


def test_recorder_skips_repeats(spark, tmp_path):
    path = str(tmp_path / "progress")
    recorder = ProgressRecorder(spark, path, "q")
    for batch, offset in enumerate([None, "a", "a", "b"]):
        recorder.record(batch, f"2024-01-01T00:00:0{batch}.500Z", [offset])
    assert rows(read_progress(spark, path), "batch_id", "start_offset") == [(1, "a"), (3, "b")]


def test_recorder_listens(spark, tmp_path):
    path = str(tmp_path / "progress")
    recorder = ProgressRecorder(spark, path, "watched")
    spark.streams.addListener(recorder)
    try:
        source = tmp_path / "in"
        for i in range(3):
            spark.range(5).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
        query = stream.writeStream.format("noop").queryName("watched").trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
        import time

        for _ in range(50):
            if recorder.last is not None and '"logOffset":1' in recorder.last:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(recorder)
    found = read_progress(spark, path)
    assert found.count() == found.select("start_offset").distinct().count() >= 1
