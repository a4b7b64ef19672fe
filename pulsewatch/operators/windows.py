"""Sliding counts, joined windows and trailing time ranges."""

from functools import reduce
from math import gcd

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsewatch.functions.times import duration, epoch_micros, instant, micros
from pulsewatch.operators.sizing import dealt, keyed_join

KEYS = ("resource", "metric")


def sliding_sums(rows, size, slide=None, keys=(), value=None, ts="ts"):
    """`cnt` (and `total` of `value`) per sliding window and key.

    A row lies in size/slide windows. Rows are first summed into panes as long as the
    greatest common divisor of both, and only panes are copied into windows.
    """
    size_us, slide_us = micros(size), micros(slide or size)
    pane_us = gcd(size_us, slide_us)
    sums = [F.count(F.lit(1)).alias("cnt")]
    if value:
        sums.append(F.sum(value).alias("total"))
    panes = (
        rows.groupBy(*keys, F.window(ts, duration(pane_us)).alias("_p"))
        .agg(*sums)
        .withColumn("_p", F.col("_p.start"))
    )
    names = ["cnt", *(["total"] if value else [])]
    window = F.window("_p", duration(size_us), duration(slide_us)).alias("w")
    return (
        panes.groupBy(*keys, window)
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *names
        )
    )


def window_alarms(rows, condition, size, slide=None, mark_count=1, keys=(), ts="ts"):
    """Windows in which at least `mark_count` rows meet a condition."""
    counted = sliding_sums(rows.where(condition), size, slide, keys, ts=ts)
    return counted.where(F.col("cnt") >= mark_count)


def window_join(rows, window_condition, join_condition, size, slide=None, mark_count=1, keys=("resource",)):
    """Rows meeting `join_condition` inside windows where `window_condition` reached its mark.

    The counted windows have one row per (window, key), so each row pairs with at most
    one of them per window it lies in.
    """
    marked = window_alarms(rows, window_condition, size, slide, mark_count, keys)
    window = F.window("ts", duration(micros(size)), duration(micros(slide or size)))
    others = (
        rows.where(join_condition)
        .withColumn("_w", window)
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )
    return keyed_join(others, marked, ["window_start", "window_end", *keys], derived=True)


def range_stats(metrics, span, as_of=None, keys=KEYS):
    """Min, max, mean and population stddev per key over the `span` before `as_of`."""
    kind = metrics.schema["ts"].dataType
    until = instant(as_of).cast(kind)
    since = (instant(as_of) - F.expr(f"interval {micros(span)} microseconds")).cast(kind)
    return (
        metrics.where(F.col("ts").between(since, until) & F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("value").alias("cnt"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("stddev"),
        )
    )


def _moments():
    """What describes a set of values and merges with others; deviations from its own mean."""
    v = F.col("_v")
    return {"n": F.count(v), "mean": F.avg(v), "total": F.sum(v), "spread": F.var_pop(v), "min": F.min(v), "max": F.max(v)}


def _moments_over(frame):
    return F.struct(*[c.over(frame).alias(n) for n, c in _moments().items()])


def _merged(a, b):
    """Moments of two disjoint sets from those of each; a null side adds nothing.

    Only the gap between the two means enters, never a mean of more than both. NaN and
    infinities stay in the sets that hold them and come out as a plain frame's would.
    """
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        ((a["total"] + b["total"]) / n).alias("mean"),
        (a["total"] + b["total"]).alias("total"),
        ((a["spread"] * a["n"] + b["spread"] * b["n"] + gap * gap * (a["n"] / n) * b["n"]) / n).alias("spread"),
        F.least(a["min"], b["min"]).alias("min"),
        F.greatest(a["max"], b["max"]).alias("max"),
    )
    return F.when(a.isNull(), b).otherwise(both)


def _of_pieces(df, pieces):
    """`df` with cnt, mean, min, max and stddev of the disjoint sets its struct columns describe."""
    none, zero = F.lit(0), F.lit(0.0)

    def over_all(part):
        return sum((part(F.col(p)) for p in pieces), zero)

    n = sum((F.coalesce(F.col(p)["n"], none) for p in pieces), none)
    total = over_all(lambda p: F.coalesce(p["total"], zero))
    known = df.withColumn("cnt", n.cast("long")).withColumn("mean", total / F.nullif(F.col("cnt"), none))

    def squares(p):
        # From the mean of this range alone.
        gap = p["mean"] - F.col("mean")
        return F.coalesce(p["n"] * (p["spread"] + gap * gap), zero)

    return known.withColumns(
        {
            "min": F.least(*[F.col(p)["min"] for p in pieces]),
            "max": F.greatest(*[F.col(p)["max"] for p in pieces]),
            "stddev": F.sqrt(over_all(squares) / F.nullif(F.col("cnt"), none)),
        }
    )


def trailing_stats(metrics, span, keys=KEYS, parts=6):
    """Every metric row with `cnt`, `mean`, `min`, `max` and population `stddev` of the `span` up to it.

    The same as a RANGE frame over each key, which would sort a whole key in one task and
    redo the frame for each row. Here time is cut into blocks of about span / parts, and a
    row's range is
      the part of its own block up to it     (head: running, oldest first),
      the whole blocks in between            (mid: at most parts - 1 of them, merged),
      the end of the block its range starts in (tail: running, newest first),
    so the largest group is one key within one block and work grows with the rows. A row
    asks for its tail by a copy of itself in that block, and a block's mids come along as a
    row of their own; one window there answers, without a join. Parts are merged pairwise.
    Tasks are sized by rows, which are counted first.
    """
    keys = list(keys)
    total = metrics.count()
    span_us = micros(span)
    width = -(-span_us // parts)
    parts = -(-span_us // width)
    block = F.expr(f"_t div {width} - if(_t % {width} < 0, 1, 0)")
    row = F.struct(*metrics.columns)
    rows = metrics.select(
        *keys, epoch_micros("ts").alias("_t"), F.col("value").cast("double").alias("_v"), row.alias("_row")
    ).withColumn("_b", block)
    by = Window.partitionBy(*keys, "_b")
    upto = by.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    headed = dealt(rows, [*keys, "_b"], total).withColumn("_head", _moments_over(upto))
    asks = headed.select(
        *keys,
        (F.col("_t") - span_us).alias("_t"),
        F.lit(None).cast("double").alias("_v"),
        "_row",
        "_head",
        F.col("_b").alias("_from"),
        F.lit(2).alias("_kind"),
    ).withColumn("_b", block)
    # Whole blocks, each copied to the blocks whose rows' ranges reach over it.
    blocks = rows.groupBy(*keys, "_b").agg(F.struct(*[c.alias(n) for n, c in _moments().items()]).alias("_m"))
    gathered = [rows.select(*keys, "_t", "_v", "_b", F.lit(1).alias("_kind")), asks]
    if parts > 1:
        reach = blocks.select(*keys, "_b", "_m", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))).alias("_d"))
        listed = reach.groupBy(*keys, (F.col("_b") - F.col("_d")).alias("_b")).agg(
            F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_l")
        )

        def folded(most):
            chosen = F.transform(F.filter("_l", lambda x: (x["_d"] <= most) & (x["_m"]["n"] > 0)), lambda x: x["_m"])
            # A range starts in the block `parts` or, with a last short part, `parts` - 1 back.
            return F.aggregate(chosen, F.lit(None).cast(blocks.schema["_m"].dataType), _merged)

        gathered.append(
            listed.select(
                *keys,
                "_b",
                F.struct(folded(parts - 1).alias("far"), folded(parts - 2).alias("near")).alias("_mid"),
                F.lit(0).alias("_kind"),
            )
        )
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), gathered)
    together = dealt(together, [*keys, "_b"], 2 * total)
    # The mids come first, then the newest rows; a row at the range's very start counts.
    newest = by.orderBy((F.col("_kind") == 0).desc(), F.desc("_t"), "_kind")
    newest = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = together.withColumn("_tail", _moments_over(newest))
    pieces = ["_tail", "_head"]
    if parts > 1:
        mid = F.first("_mid", ignorenulls=True).over(newest)
        far = F.col("_from") - F.col("_b") == parts
        found = found.withColumn("_mid", mid).withColumn("_mid", F.when(far, F.col("_mid.far")).otherwise(F.col("_mid.near")))
        pieces.append("_mid")
    answered = _of_pieces(found.where("_kind = 2"), pieces)
    return answered.select("_row.*", "cnt", "mean", "min", "max", "stddev")
