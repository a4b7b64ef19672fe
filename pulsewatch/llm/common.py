"""What several operators share: sizes, blocks of documents, fresh folders, components."""

import hashlib
import math
import pickle

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pulsewatch.session import run_dir

BLOCK_BYTES = 4 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parallelism(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark, most=BATCH_BYTES):
    """From now on the session sends workers batches of about `most` bytes, not of up to 10,000 rows whatever
    their length: an executor holds each several times over, for all of its tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def block_count(docs, text="text", block_bytes=BLOCK_BYTES):
    """How many blocks of about `block_bytes` of text the documents need."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(parallelism(docs.sparkSession), math.ceil(total / block_bytes))


def in_blocks(docs, blocks, id_col="doc_id", text_col="text"):
    """`id`, `text` and a `block` that any copy of the same row gets again.

    A block depends on the row alone, so a task that is run again finds the same rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", spread)


def stored(df, label):
    """`df` written to the shared folder and read again: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = run_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark, value):
    """A broadcast of `value` together with the code of its classes: workers may lack this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    """In a task: the value of a `shipped` broadcast, made once a worker and kept with the broadcast."""
    if not hasattr(shared, "_received"):
        shared._received = pickle.loads(shared.value)
        del shared._value  # the bytes have done their work
    return shared._received


def texts_of(column):
    """The texts of an Arrow string column as UTF-8 bytes; null gives none."""
    return [b"" if x is None else x.encode() if isinstance(x, str) else x for x in column.to_pylist()]


def block_rows(table):
    """(ids, texts) of a block in an order that depends on the rows alone."""
    ids = table.column("id").to_pylist()
    texts = texts_of(table.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def mixed(x):
    """Spread the bits of 64-bit numbers (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def components(edges, label="components", max_rounds=60):
    """Smallest label reachable for every endpoint of `edges` (src, dst): `node`, `component`.

    Alternating large-star and small-star rounds; each halves the depth of the trees, and
    each is written to the shared folder. A node is grouped only with its current
    neighbours' minimum, computed by partial aggregation; no list of neighbours is built.
    """
    both = edges.select("src", "dst").where("src <> dst")
    current = stored(both.distinct(), label)
    for _ in range(max_rounds):
        around = current.union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = around.groupBy("src").agg(F.min("dst").alias("m"))
        least = least.select("src", F.least("src", "m").alias("m"))
        # Large star: neighbours above a node move to the least of its neighbourhood.
        large = around.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = stored(large.where("src <> dst").distinct(), label)
        # Small star: a node and its lower neighbours move to the least of them.
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        lower = down.join(low, "src")
        small = lower.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(lower.select("src", F.col("m").alias("dst")))
        after = stored(small.where("src <> dst").distinct(), label)
        current = after
        # Settled when no node has several edges up, or edges both up and down.
        ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("src", 1), ("dst", 0))])
        ends = after.select(F.explode(ends).alias("end")).groupBy("end.node")
        if ends.agg(F.sum("end.up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 or (up > 0 and n > up)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    tops = current.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(tops)
