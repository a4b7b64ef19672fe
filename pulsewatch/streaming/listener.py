"""Recording where streaming queries start each batch."""

from pyspark.sql.streaming import StreamingQueryListener

from pulsewatch import schema


class ProgressRecorder(StreamingQueryListener):
    """Appends one row per progress event of the named query to a progress table.

    An offset equal to the one before, or none at all, is not recorded. One row is
    written per trigger, by the driver, to the folder `path`.
    """

    def __init__(self, spark, path, query):
        self.spark = spark
        self.path = path
        self.query = query
        self.last = None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        if progress.name == self.query:
            starts = [s.startOffset for s in progress.sources]
            self.record(progress.batchId, progress.timestamp, starts)

    def record(self, batch_id, timestamp, starts):
        """Store one event: ISO time and the start offset of every source."""
        offset = ",".join(str(s) for s in starts)
        if offset in ("", "null", "None") or offset == self.last:
            return
        row = self.spark.createDataFrame(
            [(self.query, batch_id, timestamp, offset)],
            "query string, batch_id long, ts string, start_offset string",
        )
        row = row.withColumn("ts", row["ts"].cast("timestamp"))
        row.coalesce(1).write.mode("append").parquet(self.path)
        self.last = offset

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def read_progress(spark, path):
    """The recorded progress table."""
    return spark.read.schema(schema.PROGRESS).parquet(path)
