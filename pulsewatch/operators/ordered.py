"""Order-dependent calculations that survive one key holding most of the rows.

A plain window sorts a whole key in one task. Here the largest group is measured
first. Within GROUP_ROWS the plain window is used, in tasks sized by rows; past it the rows are range
partitioned by (keys, order), materialised once, and every partition becomes a slice.
Each slice is worked out on its own, and a small table with one row per key and slice
carries the running state from slice to slice.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsewatch.operators.sizing import dealt
from pulsewatch.session import cut_lineage

GROUP_ROWS = 5_000_000


def slices(df, keys, order, limit=None):
    """`df`, the columns to partition its windows by, and whether groups had to be cut.

    Cut rows get their key as one struct `_k`, in which nulls compare like any other
    value, and a `_slice` that follows `order`; rows of one key in one slice fit a task.
    The cut is written out before use: range bounds come from a sample, and a sample
    drawn again after a lost executor must not move rows between slices.
    """
    limit = GROUP_ROWS if limit is None else limit
    sizes = df.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    size = sizes.first()
    if (size["most"] or 0) <= limit:
        return (dealt(df, keys, size["all"] or 0) if keys else df), list(keys), False
    n = max(2, math.ceil(2 * size["all"] / limit))
    keyed = df.withColumn("_k", F.struct(*keys) if keys else F.lit(0))
    ranged = keyed.repartitionByRange(n, "_k", *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id())), CUT, True


CUT = ["_k", "_slice"]


def _running(spec):
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _slice_order():
    """The slices of one key in order: at most one row per slice."""
    return Window.partitionBy("_k").orderBy("_slice")


def _before():
    """All earlier slices of the same key."""
    return _slice_order().rowsBetween(Window.unboundedPreceding, -1)


def streaks(df, keys, order, flag, limit=None):
    """`streak`: rows in a row, up to and with this one, for which `flag` is true."""
    cut, by, split = slices(df, keys, order, limit)
    spec = Window.partitionBy(*by).orderBy(*order)
    held = F.coalesce(F.col(flag), F.lit(False))
    numbered = cut.withColumn("_n", F.row_number().over(spec))
    last_break = F.max(F.when(~held, F.col("_n"))).over(_running(spec))
    local = numbered.withColumn("_break", last_break)
    streak = F.col("_n") - F.coalesce("_break", F.lit(0))
    if not split:
        return local.withColumn("streak", streak.cast("long")).drop("_n", "_break")

    ends = local.groupBy(*CUT).agg(F.max("_n").alias("_rows"), F.max("_break").alias("_break_at"))
    tail = F.col("_rows") - F.coalesce("_break_at", F.lit(0))
    broken = F.col("_break_at").isNotNull().cast("int")
    runs = ends.withColumn("_tail", tail).withColumn(
        "_run", F.sum(broken).over(_running(_slice_order()))
    )
    in_run = _running(Window.partitionBy("_k", "_run").orderBy("_slice"))
    reached = runs.withColumn("_reached", F.sum("_tail").over(in_run))
    carry = reached.select(*CUT, F.lag("_reached", 1, 0).over(_slice_order()).alias("_carry"))
    first_run = F.when(F.col("_break").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return (
        local.join(carry, CUT, "left")
        .withColumn("streak", (streak + first_run).cast("long"))
        .drop("_n", "_break", "_carry", *CUT)
    )


def running_sum(df, keys, order, value, name, limit=None):
    """Sum of `value` over this row and all before it."""
    cut, by, split = slices(df, keys, order, limit)
    spec = Window.partitionBy(*by).orderBy(*order)
    local = cut.withColumn(name, F.sum(value).over(_running(spec)))
    if not split:
        return local
    totals = cut.groupBy(*CUT).agg(F.sum(value).alias("_sum"))
    carry = totals.select(*CUT, F.sum("_sum").over(_before()).alias("_carry"))
    total = F.coalesce(F.col(name) + F.col("_carry"), F.col(name), F.col("_carry"))
    return local.join(carry, CUT, "left").withColumn(name, total).drop("_carry", *CUT)


def previous(df, keys, order, value, name, limit=None):
    """`value` of the row before this one; NULL at the start."""
    cut, by, split = slices(df, keys, order, limit)
    spec = Window.partitionBy(*by).orderBy(*order)
    if not split:
        return cut.withColumn(name, F.lag(value).over(spec))
    # Boxed, to tell a null value before this row from no row before it.
    local = cut.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(spec))
    at_end = F.max(F.struct(*order, F.col(value).alias("v")))
    ends = cut.groupBy(*CUT).agg(at_end.alias("_end"))
    carry = ends.select(*CUT, F.lag("_end.v").over(_slice_order()).alias("_carry"))
    before = F.coalesce("_prev", F.struct(F.col("_carry").alias("v")))["v"]
    return local.join(carry, CUT, "left").withColumn(name, before).drop("_prev", "_carry", *CUT)


def last_known(df, keys, order, value, name, limit=None):
    """Last non-null `value` on this row or before it."""
    cut, by, split = slices(df, keys, order, limit)
    spec = Window.partitionBy(*by).orderBy(*order)
    local = cut.withColumn(name, F.last(value, ignorenulls=True).over(_running(spec)))
    if not split:
        return local
    known = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("v")))
    ends = cut.groupBy(*CUT).agg(F.max(known).alias("_end"))
    newest = F.last("_end.v", ignorenulls=True).over(_before())
    carry = ends.select(*CUT, newest.alias("_carry"))
    return local.join(carry, CUT, "left").withColumn(name, F.coalesce(name, "_carry")).drop("_carry", *CUT)
