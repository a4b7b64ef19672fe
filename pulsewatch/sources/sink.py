"""A sink for alarms, as a data source that batches and streams write to: `format("alarm_sink")`.

Tasks write files under names of their own. The driver's commit names the files of a batch in one
small file, which makes them visible all at once; what a failed task or an aborted batch wrote is named
nowhere and never read. A batch that is tried again after it was committed changes nothing.
"""

import json
import sys
import uuid

import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from pulsewatch.sources.files import names_in, place, put_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Written(WriterCommitMessage):
    """The files one task has written."""

    def __init__(self, files):
        self.files = files


class _Files:
    """What batch and stream writers have in common."""

    def __init__(self, path):
        self.path = path.rstrip("/")

    def write(self, iterator):
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Written([])
        system, path = place(self.path)
        name = f"{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{path}/files", recursive=True)
        with system.open_output_stream(f"{path}/files/{name}", compression=None) as out:
            with pq.ParquetWriter(out, first.schema) as writer:
                writer.write_batch(first)
                for batch in batches:
                    writer.write_batch(batch)
        return Written([name])

    def publish(self, messages, name):
        system, path = place(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        if not put_once(system, f"{path}/commits/{name}.json", json.dumps({"files": files}).encode()):
            self.discard(messages)

    def discard(self, messages):
        system, path = place(self.path)
        for m in messages:
            for name in m.files if m is not None else []:
                system.delete_file(f"{path}/files/{name}")


class StreamSink(DataSourceStreamArrowWriter):
    def __init__(self, path):
        self.files = _Files(path)

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages, batchId):
        self.files.publish(messages, f"stream-{batchId}")

    def abort(self, messages, batchId):
        self.files.discard(messages)


class BatchSink(DataSourceArrowWriter):
    def __init__(self, path):
        self.files = _Files(path)

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages):
        self.files.publish(messages, f"batch-{uuid.uuid4().hex}")

    def abort(self, messages):
        self.files.discard(messages)


class AlarmSink(DataSource):
    """Option `path`: the folder. One streaming query writes to a folder; any number of batches may."""

    @classmethod
    def name(cls):
        return "alarm_sink"

    def schema(self):
        raise NotImplementedError("alarm_sink is written to; read_committed reads it")

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("alarm_sink only appends")
        return BatchSink(self.options["path"])

    def streamWriter(self, schema, overwrite):
        return StreamSink(self.options["path"])


def register_sink(spark):
    spark.dataSource.register(AlarmSink)


def start_sink(df, path, checkpoint, available_now=False, every=None):
    """Append a stream to the sink, each row once, whatever fails and is tried again."""
    register_sink(df.sparkSession)
    writer = df.writeStream.format("alarm_sink").option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def read_committed(spark, path, schema):
    """All rows of committed batches."""
    system, root = place(path)
    names = names_in(system, f"{root}/commits")
    files = []
    for name in names:
        if name.endswith(".json") and not name.startswith("."):
            with system.open_input_file(f"{root}/commits/{name}") as file:
                files += json.loads(file.read())["files"]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/files/{f}" for f in files])
