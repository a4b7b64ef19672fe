"""Joins that broadcast only what was measured small, and salt hot keys otherwise."""

import math
from functools import reduce

from pyspark.sql import functions as F

from pulsewatch.session import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 5_000_000
NULL_SALTS = 256
#: Rows a task sorts at once, about.
TASK_ROWS = 500_000


def row_bytes(schema):
    """About the bytes of a row: texts by their length, nested values by that of their JSON."""
    out = F.lit(0)
    for field in schema:
        kind, col = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(col), F.lit(0)) + 8
        elif kind in ("array", "map", "struct"):
            out = out + F.octet_length(F.to_json(F.struct(col)))
        else:
            out = out + 16
    return out


def fits_broadcast(df, max_rows=None, max_bytes=None):
    """Whether `df` is within both bounds; reads at most one row past the row bound."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    width = row_bytes(df.schema)
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def tasks_for(spark, rows):
    """How many tasks sort so many rows; None where few rows may be left to Spark.

    Adaptive execution makes tasks of equal compressed bytes, and rows that compress well come
    to many times that in memory. A number of partitions that is asked for is left alone.
    """
    tasks = math.ceil(rows / TASK_ROWS)
    return None if tasks <= 1 else max(tasks, spark.sparkContext.defaultParallelism)


def dealt(df, keys, rows):
    """`df`, of about so many rows, partitioned by keys into tasks of about TASK_ROWS rows."""
    tasks = tasks_for(df.sparkSession, rows)
    return df if tasks is None else df.repartition(tasks, *keys)


def keyed_join(big, small, keys, how="inner", derived=False, bounded_by=None):
    """Equi-join of a large frame with a usually small one, on equally named keys.

    `small` is broadcast when measured within bounds. Past them both sides shuffle,
    and keys with more than HOT_ROWS rows in `big` are spread over tasks of about that many
    rows, the matching `small` rows being copied to each. Set `derived` where `small` is the
    outcome of real work, so that it is computed once and not again for the join.
    `bounded_by` names a frame `small` was projected or reduced from, to be measured in
    its place.
    """
    keys = list(keys)
    if derived:
        small = cut_lineage(small)
    if fits_broadcast(small if bounded_by is None else bounded_by):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how)


def salted_join(big, small, keys, how="inner", hot_rows=None, salts=None, rows=None, counted=None):
    """Shuffled equi-join in which hot keys of `big` are split over many tasks. `rows`, where known,
    is about how many rows `big` has, and sizes the tasks. `counted`: see `salted_sides`."""
    left, right = salted_sides(big, small, keys, hot_rows, salts, counted)
    if rows is not None:
        left, right = (dealt(side, [*keys, "_salt"], rows) for side in (left, right))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def salted_sides(big, small, keys, hot_rows=None, salts=None, counted=None):
    """Both sides with a `_salt` column to join on next to the keys.

    Rows of hot keys in `big` are spread over as many salts as they fill tasks of `hot_rows`
    (or `salts`, where given), and `small` is copied to each of them; other keys keep a
    single salt. Rows with a null key, which match nothing, are spread as well. Where `big` is the
    outcome of real work, `counted` names a frame that has the keys as often and only columns of
    `big`; hot keys are found and rows are spread by it, and `big` is not worked out twice.
    """
    counted = big if counted is None else counted
    keys = list(keys)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    many = F.lit(salts) if salts else F.ceil(F.col("count") / hot_rows)
    # At most rows(big) / hot_rows keys can be hot, which bounds this broadcast.
    hot = counted.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys, many.cast("int").alias("_many"))
    plain = [f.name for f in counted.schema if f.dataType.typeName() not in ("map", "variant")]
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.when(no_key, F.lit(NULL_SALTS)).otherwise(F.coalesce("_many", F.lit(1)))
    left = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*plain), spread).cast("int")
    )
    copies = F.sequence(F.lit(0), F.coalesce("_many", F.lit(1)) - 1)
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies))
    return left.drop("_many"), right.drop("_many")
