import pytest
from conftest import rows

from pulsewatch.sources import sink

SCHEMA = "a long, b string"


def feed(spark, base, values):
    spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")


def stream(spark, base):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def shown(spark, base):
    return rows(sink.read_committed(spark, f"{base}/out", SCHEMA))


def test_a_stream_and_batches(spark, tmp_path):
    feed(spark, tmp_path, [(1, "x"), (2, None)])
    feed(spark, tmp_path, [(3, "y")])
    sink.start_sink(stream(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    assert shown(spark, tmp_path) == [(1, "x"), (2, None), (3, "y")]
    spark.range(4).selectExpr("id AS a", "'batch' AS b").repartition(3).write.format("alarm_sink").mode("append").save(f"{tmp_path}/out")
    assert len(shown(spark, tmp_path)) == 7


def test_a_failed_task_shows_nothing_and_a_retry_shows_once(spark, tmp_path):
    sink.register_sink(spark)
    marker = f"{tmp_path}/failed"

    def fails_once(batches):
        import os

        for batch in batches:
            yield batch
            if not os.path.exists(marker):
                open(marker, "w").close()
                raise RuntimeError("the task ends here")

    feed(spark, tmp_path, [(i, "x") for i in range(20)])
    for expected in ([], [(i, "x") for i in range(20)]):
        query = sink.start_sink(stream(spark, tmp_path).mapInArrow(fails_once, SCHEMA), f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True)
        if expected:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="the task ends here"):
                query.awaitTermination()
        assert shown(spark, tmp_path) == sorted(expected, key=repr)


def test_a_batch_committed_twice_shows_once(tmp_path):
    import pyarrow as pa

    writer = sink.StreamSink(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"a": [1, 2], "b": ["x", "y"]})
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([first, None], 7)
    writer.commit([again], 7)
    assert len(list((tmp_path / "commits").iterdir())) == 1
    assert [f.name for f in (tmp_path / "files").iterdir()] == first.files
    writer.abort([writer.write(iter([batch])), None], 8)
    assert len(list((tmp_path / "files").iterdir())) == 1


def test_nothing_written_yet(spark, tmp_path):
    assert shown(spark, tmp_path) == []
