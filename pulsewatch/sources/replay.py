"""Replay of an event log from any offset, as a data source for batches and streams: `format("event_log")`.

A log is a folder of Parquet files, each a stretch of consecutive offsets of one partition, and an
index with one row per file. A stream starts at a given offset of each partition, takes at most so many
rows a micro-batch, and reads of the files only the rows between its offsets.
"""

import json
import sys

import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from pulsewatch.operators.ordered import running_sum
from pulsewatch.sources.files import place

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_ROWS = 1_000_000
BATCH_ROWS = 10_000
MAX_ROWS = 100_000


def write_log(rows, path, partition, order, topic="metric", file_rows=FILE_ROWS):
    """Appends nothing: writes a new log of `rows` below `path`.

    `partition` is an integer column; rows of a partition get offsets from 0 in the given order.
    Files hold up to `file_rows` rows. The index is written last and completes the log.
    """
    spark = rows.sparkSession
    numbered = running_sum(rows.withColumn("_one", F.lit(1)), [partition], order, "_one", "offset").drop("_one")
    numbered = numbered.withColumn("offset", (F.col("offset") - 1).cast("long")).withColumn("_file", F.floor(F.col("offset") / file_rows))
    base = path.rstrip("/")
    dealt = numbered.repartition(F.col(partition), F.col("_file")).sortWithinPartitions(partition, "_file", "offset")
    dealt.withColumn("_partition", F.col(partition)).write.partitionBy("_partition", "_file").parquet(f"{base}/data")
    index = spark.read.schema(numbered.schema).parquet(f"{base}/data").select(partition, "offset", F.input_file_name().alias("file"))
    bounds = index.groupBy(F.col(partition).cast("long").alias("partition"), "file").agg(
        F.min("offset").alias("first"), (F.max("offset") + 1).alias("until")
    )
    bounds.withColumn("topic", F.lit(topic)).coalesce(1).write.parquet(f"{base}/index")
    return f"{base}"


def index_of(path):
    """{partition: [(first, until, file)]} of a log, in order of offsets."""
    system, root = place(f"{path}/index")
    out = {}
    for r in pq.read_table(root, filesystem=system, columns=["partition", "file", "first", "until"]).to_pylist():
        out.setdefault(r["partition"], []).append((r["first"], r["until"], r["file"]))
    return {p: sorted(files) for p, files in sorted(out.items())}


class Stretch(InputPartition):
    """Rows of one file from one offset until before another."""

    def __init__(self, file, first, until):
        self.file, self.first, self.until = file, first, until


def stretches(index, start, end):
    """What has to be read between two offsets of all partitions."""
    out = []
    for p, files in index.items():
        low, high = start.get(str(p), 0), end.get(str(p), 0)
        out += [Stretch(f, max(a, low), min(b, high)) for a, b, f in files if a < high and b > low]
    return out


def rows_of(stretch, columns):
    """Record batches of a stretch; row groups beyond its offsets are not read."""
    system, path = place(stretch.file)
    with system.open_input_file(path) as opened:
        file = pq.ParquetFile(opened)
        at = file.schema_arrow.get_field_index("offset")
        groups = []
        for g in range(file.num_row_groups):
            told = file.metadata.row_group(g).column(at).statistics
            if told is None or not told.has_min_max or (told.min < stretch.until and told.max >= stretch.first):
                groups.append(g)
        for batch in file.iter_batches(BATCH_ROWS, row_groups=groups, columns=columns):
            offsets = batch.column(batch.schema.get_field_index("offset")).to_numpy()
            low, high = offsets.searchsorted([stretch.first, stretch.until])
            if low < high:
                yield batch.slice(int(low), int(high - low))


def starting_offsets(spec, topic, index):
    """The offset each partition starts at: `earliest`, `latest`, or JSON as recorded progress has
    it, `{"topic": {"0": 3}}`; partitions it does not name start at 0."""
    ends = {str(p): files[-1][1] for p, files in index.items()}
    if spec == "earliest":
        return {p: 0 for p in ends}
    if spec == "latest":
        return ends
    named = json.loads(spec).get(topic, {})
    return {p: min(int(named.get(p, 0)), end) for p, end in ends.items()}


class LogReader(DataSourceReader):
    """All rows from the start to the end of the log."""

    def __init__(self, path, columns, start, topic):
        self.path, self.columns, self.start, self.topic = path, columns, start, topic

    def partitions(self):
        index = index_of(self.path)
        ends = {str(p): files[-1][1] for p, files in index.items()}
        return stretches(index, starting_offsets(self.start, self.topic, index), ends) or [Stretch(None, 0, 0)]

    def read(self, partition):
        if partition.file is not None:
            yield from rows_of(partition, self.columns)


class LogStream(DataSourceStreamReader):
    """Offsets are {partition: next offset}. Each micro-batch takes up to `most` rows, shared evenly.

    How far the stream has come is kept in a file next to the checkpoint, as a restarted stream
    is asked how far it may go before it is told where it stands.
    """

    def __init__(self, path, columns, start, topic, most, position):
        self.path, self.columns, self.start, self.topic = path, columns, start, topic
        self.most, self.position, self.at = most, position, None

    def initialOffset(self):
        self.at = starting_offsets(self.start, self.topic, index_of(self.path))
        return dict(self.at)

    def reached(self):
        if self.at is None:
            system, path = place(self.position)
            if system.get_file_info(path).is_file:
                with system.open_input_file(path) as file:
                    self.at = json.loads(file.read())
            else:
                self.initialOffset()
        return self.at

    def latestOffset(self):
        at, index = self.reached(), index_of(self.path)
        step = max(1, self.most // max(1, len(index)))
        return {str(p): min(files[-1][1], at.get(str(p), 0) + step) for p, files in index.items()}

    def partitions(self, start, end):
        self.at = dict(end)
        system, path = place(self.position)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{path}.making", compression=None) as file:
            file.write(json.dumps(end).encode())
        system.move(f"{path}.making", path)
        return stretches(index_of(self.path), start, end) or [Stretch(None, 0, 0)]

    def read(self, partition):
        if partition.file is not None:
            yield from rows_of(partition, self.columns)


class EventLog(DataSource):
    """Options: `path` of a log, `topic`, `start` (see `starting_offsets`), and for streams `maxRows`
    a micro-batch and `position`, a file next to the checkpoint."""

    @classmethod
    def name(cls):
        return "event_log"

    def schema(self):
        raise NotImplementedError("name the log's schema with .schema(...)")

    def _about(self, schema):
        return self.options["path"].rstrip("/"), schema.fieldNames(), self.options.get("start", "earliest"), self.options.get("topic", "metric")

    def reader(self, schema):
        return LogReader(*self._about(schema))

    def streamReader(self, schema):
        return LogStream(*self._about(schema), int(self.options.get("maxRows", MAX_ROWS)), self.options["position"])


def _options(reader, path, schema, start, topic):
    reader = reader.format("event_log").schema(f"{schema}, offset long").option("path", path)
    return reader.option("start", start).option("topic", topic)


def read_log(spark, path, schema, start="earliest", topic="metric"):
    """The log from `start` on; `schema` names its columns, `offset` is added."""
    spark.dataSource.register(EventLog)
    return _options(spark.read, path, schema, start, topic).load()


def stream_log(spark, path, schema, checkpoint, start="earliest", topic="metric", max_rows=MAX_ROWS):
    """The log as a stream; a new checkpoint begins at `start`, a known one goes on from where it was."""
    spark.dataSource.register(EventLog)
    reader = _options(spark.readStream, path, schema, start, topic)
    return reader.option("maxRows", str(max_rows)).option("position", f"{checkpoint.rstrip('/')}-position.json").load()
