"""View tables that a stream feeds with small partial results.

Every micro-batch writes its own folder `delta/batch_id=N`, over itself when the batch
is tried again, so nothing is counted twice. Readers merge all folders by key with the
same associative aggregate. `compact` folds finished batches into one base folder
`base/upto=N`, which readers use from the moment its write is complete.
"""

import json
import time
import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewatch.functions.times import epoch_micros, micros


COMPACT_EVERY = 100
#: Seconds for which folding leaves the folders alone that a reader was given.
LEASE_SECONDS = 3600
STRETCH = "_stretch"


def folder_path(spark, path):
    """A folder and the file system it is on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def numbered_folders(spark, path, label="batch_id"):
    """Sorted numbers N of the finished folders `label=N` under a path: one listing of files."""
    root, fs = folder_path(spark, path)
    if not fs.exists(root):
        return []
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{label}=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done or [])


def make_folder(spark, path):
    """A folder a stream can watch before anything is written to it."""
    found, fs = folder_path(spark, path)
    fs.mkdirs(found)


def remove_folder(spark, path):
    found, fs = folder_path(spark, path)
    fs.delete(found, True)


class PartialTable:
    """Partial results in a shared folder; `merge` turns any number of them into one per key.

    With `layout`, a pair of a time column and a duration, folders are divided by stretches of that
    time, and a read `between` two times opens only the stretches that lie there. The column has to
    be a key of the merge.
    """

    def __init__(self, spark, path, schema, merge, layout=None, lease=LEASE_SECONDS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.merge = merge
        self.layout = layout
        self.lease = lease

    def _stretch(self, time):
        return F.floor(epoch_micros(time) / micros(self.layout[1])).cast("long")

    def _store(self, rows, path):
        if self.layout is None:
            rows.write.mode("overwrite").parquet(path)
        else:
            dealt = rows.withColumn(STRETCH, self._stretch(self.layout[0])).repartition(STRETCH)
            dealt.write.mode("overwrite").partitionBy(STRETCH).parquet(path)

    def write(self, partials, batch_id):
        """Store one batch's partials; a retried batch replaces its own."""
        self._store(partials, f"{self.path}/delta/batch_id={batch_id}")

    def _numbers(self, label, above=-1):
        """Numbers over `above` of the finished folders `label=N`."""
        kind = {"upto": "base", "batch_id": "delta"}[label]
        return [n for n in numbered_folders(self.spark, f"{self.path}/{kind}", label) if n > above]

    def holds(self, batch_id):
        """Whether a batch's partials are stored, in a folder of their own or folded."""
        return max(self._numbers("upto"), default=-1) >= batch_id or batch_id in self._numbers("batch_id")

    def _partials(self, before=None):
        upto = max(self._numbers("upto"), default=-1)
        deltas = [n for n in self._numbers("batch_id", upto) if before is None or n < before]
        paths = [f"delta/batch_id={n}" for n in deltas]
        if upto >= 0:
            paths.append(f"base/upto={upto}")
        if not paths:
            found = self.spark.createDataFrame([], self.schema)
            return found if self.layout is None else found.withColumn(STRETCH, F.lit(0).cast("long")), upto
        self._hold(paths)
        if self.layout is None:
            found = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])
        else:
            # Each folder is divided below itself.
            reader = self.spark.read.schema(f"{self.schema}, {STRETCH} long")
            own = [reader.option("basePath", f"{self.path}/{p}").parquet(f"{self.path}/{p}") for p in paths]
            found = reduce(lambda a, b: a.unionByName(b), own)
        return found, max(deltas, default=upto)

    def _hold(self, folders):
        """Leases folders for the reader that is about to be given them; `clean` goes round them."""
        if self.lease:
            until = int((time.time() + self.lease) * 1000)
            file, fs = folder_path(self.spark, f"{self.path}/leases/{until}-{uuid.uuid4().hex}")
            out = fs.create(file, False)
            try:
                out.write(bytearray(json.dumps(folders).encode()))
            finally:
                out.close()

    def _held(self):
        """Folders under a lease; leases that have run out are removed."""
        root, fs = folder_path(self.spark, f"{self.path}/leases")
        held = set()
        for status in fs.listStatus(root) if fs.exists(root) else []:
            file = status.getPath()
            if int(file.getName().split("-")[0]) < time.time() * 1000:
                fs.delete(file, False)
                continue
            stream = fs.open(file)
            try:
                held |= set(json.loads(bytes(stream.readAllBytes()) or b"[]"))
            finally:
                stream.close()
        return held

    def read(self, only=None, before=None, between=None):
        """The view: one row per key. `only` (a condition) is put below the merge: it may name
        key columns, and times that a merge can only raise, as retention does. With `before` the
        view as batches before that one left it, for that batch to go on from; a table is folded
        only at the end of a batch, so the base holds none of its own partials by then. `between` (two
        times) keeps the rows of a divided table whose time lies there, both ends included."""
        found = self._partials(before)[0]
        if between is not None:
            low, high = (F.lit(t).cast("timestamp") for t in between)
            first, last = (F.floor(F.unix_micros(t) / micros(self.layout[1])).cast("long") for t in (low, high))
            time_of = F.col(self.layout[0]).cast("timestamp")
            found = found.where(F.col(STRETCH).between(first, last) & time_of.between(low, high))
        found = found.drop(STRETCH) if self.layout is not None else found
        return self.merge(found if only is None else found.where(only))

    def keep(self, batch_id, every=COMPACT_EVERY, expired=None):
        """Fold and clean the table after every so many batches; for the end of a batch's handler."""
        if every and batch_id % every == every - 1:
            self.compact(expired)
            self.clean()

    def compact(self, expired=None):
        """Fold all finished batches into a new base; returns the last batch it holds.

        Keys for which the condition `expired` holds after the merge are left out.

        Folded folders stay until `clean`: a reader may have listed them just before.
        """
        found, last = self._partials()
        if last >= 0 and last not in self._numbers("upto"):
            names = T.StructType.fromDDL(self.schema).fieldNames()
            merged = self.merge(found.select(*names))
            if expired is not None:
                merged = merged.where(~F.coalesce(expired, F.lit(False)))
            self._store(merged.select(*names), f"{self.path}/base/upto={last}")
        return last

    def clean(self):
        """Remove what the base before the newest one already held, and bases before that, but for
        folders a reader holds a lease on."""
        bases = self._numbers("upto")
        if len(bases) < 2:
            return
        kept = bases[-2]
        old = [("base", f"upto={n}") for n in bases[:-2]]
        old += [("delta", f"batch_id={n}") for n in self._numbers("batch_id") if n <= kept]
        held = self._held() if old else ()
        for below in old:
            if "/".join(below) not in held:
                remove_folder(self.spark, "/".join([self.path, *below]))


def batch_folder(df, path, batch_id):
    """Write one micro-batch under its number, over an earlier try of the same batch."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_batches(spark, path, schema):
    """All batches written with `batch_folder`, with their `batch_id`."""
    return spark.read.schema(f"{schema}, batch_id long").parquet(path)


def batch_stream(spark, path, schema, **options):
    """The same as a stream, one file or more per micro-batch."""
    reader = spark.readStream.schema(f"{schema}, batch_id long").options(**options)
    return reader.parquet(path)


def to_kafka(df, servers, topic, value):
    """Write one batch to a Kafka topic; a retried batch may send messages again."""
    out = df.select(F.col("rule_id").alias("key"), value.alias("value"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
