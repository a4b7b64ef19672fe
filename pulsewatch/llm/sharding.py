"""Shards of near-equal bytes: a minimax cut of texts in a fixed order, equal texts together.

Groups of equal texts are ordered by the hash of their text. The smallest capacity with
which a greedy pass fills no more than the wanted shards is found by binary search. The
driver never holds the groups: it sees them summed by hash prefix, a bounded table, and
asks for longer prefixes only where a cut could fall, until every cut stands between two
groups. The capacity is then the exact minimax one.

A group that is as large as a whole shard's fair share gets a shard of its own first, so
that it does not raise the capacity of the others; at most `shards` groups can be so large.
"""

import bisect
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsewatch.llm.common import read, stored

SHARDS = 40
ROW_BYTES = 16
SLOT_ROWS = 1_000
FIRST_PREFIX = 3


def greedy(ends, capacity, shards, divisible=None):
    """Cut positions (numbers of items) when each shard takes as many items as fit, or None.

    `ends` are running sums. Items for which `divisible` is true may be cut anywhere, which
    gives the positions in bytes instead; that is the most any cut can reach.
    """
    cuts, at, total = [], 0, ends[-1]
    for _ in range(shards):
        reach = at + capacity
        if reach >= total:
            return cuts
        i = bisect.bisect_right(ends, reach)
        end = ends[i - 1] if i else 0
        if divisible is not None and divisible[i]:
            end = reach
        if end <= at:
            return None
        cuts.append(i if divisible is None else end)
        at = end
    return None


def smallest_capacity(ends, shards, divisible=None):
    low, high = max(1, -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def running(sizes):
    out, total = [], 0
    for s in sizes:
        total += s
        out.append(total)
    return out


def minimax_cuts(items, shards, refine):
    """(capacity, the keys that start the second and later shards).

    `items` are ordered (prefix, bytes, groups); `refine(prefixes)` gives them longer.
    """
    while True:
        ends = running([b for _, b, _ in items])
        open_items = [n > 1 for _, _, n in items]
        most = smallest_capacity(ends, shards)
        least = smallest_capacity(ends, shards, open_items)
        # A cut lies no farther than its number times the most capacity, and no nearer
        # than where whole items are kept together at the least capacity.
        near, at = [], 0
        for _ in range(shards - 1):
            i = bisect.bisect_right(ends, at + least)
            at = ends[i - 1] if i else 0
            near.append(at)
        doubtful = set()
        for j, low in enumerate(near, 1):
            a = bisect.bisect_right(ends, low)
            b = bisect.bisect_right(ends, j * most)
            doubtful.update(i for i in range(a, min(b + 1, len(items))) if open_items[i])
        if not doubtful:
            return most, [items[i][0] for i in greedy(ends, most, shards)]
        finer = refine([items[i][0] for i in sorted(doubtful)])
        items = sorted([x for i, x in enumerate(items) if i not in doubtful] + finer)


def shard(docs, shards=SHARDS, row_bytes=ROW_BYTES, first_prefix=FIRST_PREFIX, slot_rows=SLOT_ROWS, id_col="doc_id", text_col="text"):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    The law is `bytes`. A row's size is the UTF-8 bytes of its text (null: none) plus
    `row_bytes`. Equal texts go to one shard; null texts are one group and empty ones
    another. Slots count from 0 in every shard without gaps; equal rows get slots of their
    own, and null ids are kept. grown_shard is null, as this law does not grow. With fewer
    groups than shards some shards stay empty. Further columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # Null texts sort before every hash.
        F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")).alias("key"),
    )
    rows = stored(rows, "sized")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    totals = groups.agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n")).first()
    total, count = totals["b"] or 0, totals["n"] or 0

    # Fewer than `shards` groups can hold more than an equal share each.
    large = groups.where(F.col("bytes") * shards > total).orderBy(F.desc("bytes"), "key").collect()
    alone, left, free = [], total, shards
    for g in large:
        if free > 1 and g["bytes"] * free > left:
            alone.append(g["key"])
            left, free = left - g["bytes"], free - 1
    small = groups.where(~F.col("key").isin(alone)) if alone else groups

    def summed(frame, length):
        prefix = F.substring("key", 1, length).alias("prefix")
        return [tuple(r) for r in frame.groupBy(prefix).agg(F.sum("bytes"), F.count(F.lit(1))).collect()]

    def refine(prefixes):
        out = []
        for length in sorted({len(p) for p in prefixes}):
            own = spark.createDataFrame([(p,) for p in prefixes if len(p) == length], "p string")
            some = small.join(F.broadcast(own), F.substring("key", 1, length) == F.col("p"), "left_semi")
            out += summed(some, length + 1)
        return out

    starts = minimax_cuts(sorted(summed(small, first_prefix)), free, refine)[1] if left else []
    number = F.lit(len(alone))
    for i, start in enumerate(starts, 1):
        number = F.when(F.col("key") >= start, len(alone) + i).otherwise(number)
    for i, key in enumerate(alone):
        number = F.when(F.col("key") == key, i).otherwise(number)
    pieces = max(1, math.ceil(count / (shards * slot_rows)))
    placed = rows.withColumn("shard", number.cast("int")).withColumn(
        "piece", F.pmod(F.xxhash64("doc_id", "key"), F.lit(pieces))
    )
    filled = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "key"))
    return (
        placed.withColumn("within", within)
        .join(offsets, ["shard", "piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op3_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))
