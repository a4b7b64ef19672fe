"""Rules of a key compiled to disjoint value intervals.

The thresholds of a key's rules cut the numbers into points and gaps. A sweep over these cells, with
running minima from below and from above, finds for each the first rule in order that holds in
it, whatever their number. A metric row is then matched by one binary search for its value.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewatch.operators.sizing import fits_broadcast, salted_sides
from pulsewatch.session import cut_lineage

KEYS = ("resource", "metric")
CELLS = "_bounds array<double>, _cells array<int>, _ids array<string>"
HOT_ROWS = 500_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sweep(thresholds, ops):
    """(bounds, cells): the sorted thresholds, and for every cell the number of the first rule.

    Rules come in order. Cell 2i + 1 is the i-th bound itself and cell 2i the gap below it; the last
    cell is the gap above all. No rule is -1. NaN is above every number and equal to itself.
    """
    bounds = np.unique(thresholds)
    at = np.searchsorted(bounds, thresholds)
    n, cells = len(thresholds), 2 * len(bounds) + 1
    number = np.arange(n)
    upward, downward, here = (np.full(cells, n) for _ in range(3))

    def enter(into, chosen, place):
        np.minimum.at(into, place[chosen], number[chosen])

    point = 2 * at + 1
    unequal = np.isin(ops, ("!=", "<>"))
    enter(upward, (ops == ">") | unequal, point + 1)
    enter(upward, ops == ">=", point)
    enter(downward, (ops == "<") | unequal, point - 1)
    enter(downward, ops == "<=", point)
    enter(here, ops == "=", point)
    upward = np.minimum.accumulate(upward)
    downward = np.minimum.accumulate(downward[::-1])[::-1]
    first = np.minimum(np.minimum(upward, downward), here)
    return bounds, np.where(first < n, first, -1)


def cells_of(bounds, values):
    """The cell of each value."""
    at = np.searchsorted(bounds, values)
    near = bounds[np.minimum(at, len(bounds) - 1)] if len(bounds) else values
    same = (at < len(bounds)) & ((near == values) | (np.isnan(near) & np.isnan(values)))
    return 2 * at + same


def compile_rules(rules, keys=KEYS, order="rule_order"):
    """One row per key with its cells. Rules without a threshold or key or with an unknown operator
    hold nowhere.

    Of rules with one comparison on a key only the first is kept, before keys are gathered.
    The comparisons of one key have to fit a task; without `order` rules go by their id.
    """
    keys = list(keys)
    known = rules.where(F.col("op").isin("=", ">", ">=", "<", "<=", "!=", "<>") & F.col("threshold").isNotNull())
    known = known.where(" and ".join(f"{k} is not null" for k in keys))
    place = F.struct((F.col(order) if order else F.lit(0)).alias("order"), "rule_id")
    first = known.groupBy(*keys, F.col("threshold").cast("double").alias("threshold"), "op").agg(F.min(place).alias("at"))
    slim = first.select(*keys, "threshold", "op", F.col("at.order").alias("_order"), F.col("at.rule_id").alias("rule_id"))
    key_fields = [slim.schema[k] for k in keys]
    out = T.StructType(key_fields + T.StructType.fromDDL(CELLS).fields)

    def run(table):
        table = table.sort_by([("_order", "ascending"), ("rule_id", "ascending")])
        thresholds = table.column("threshold").to_numpy()
        bounds, cells = sweep(thresholds, np.array(table.column("op").to_pylist()))
        used, place_of = np.unique(cells, return_inverse=True)
        ids = [None if i < 0 else table.column("rule_id")[int(i)].as_py() for i in used]
        own = [table.column(k)[:1] for k in keys]
        packed = [pa.array([bounds], pa.list_(pa.float64())), pa.array([place_of.astype(np.int32)], pa.list_(pa.int32()))]
        return pa.table([*own, *packed, pa.array([ids], pa.list_(pa.string()))], names=[*keys, "_bounds", "_cells", "_ids"])

    return slim.groupBy(*keys).applyInArrow(run, out)


def matches(values, bounds, cells, ids):
    """The first rule of each value; None without one or for a null value."""
    missing = values.is_null().to_numpy(zero_copy_only=False)
    numbers = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    found = np.array([*ids, None], object)[cells[cells_of(bounds, numbers)]]
    found[missing] = None
    return found


def first_match_intervals(metrics, rules, keys=KEYS, value="value", order="rule_order", spread=None):
    """Every metric row once, with the first rule that holds or `id = ''`, `chk = 0`.

    The same result as `detect.first_match`; the cost of a row grows with the logarithm of its key's
    rules, not with their number. Compiled keys are written out once and, where measured small, sent to
    every task, so metric rows do not move. Past the bound (or with `spread`) both sides meet by key,
    hot keys split over many tasks with a copy of their intervals each.
    """
    keys = list(keys)
    compiled = cut_lineage(compile_rules(rules, keys, order))
    out = T.StructType([*metrics.schema.fields, T.StructField("id", T.StringType()), T.StructField("chk", T.IntegerType())])

    def judged(batch, chosen):
        ids = pa.array(["" if x is None else x for x in chosen], pa.string())
        hit = pa.array([int(x is not None) for x in chosen], pa.int32())
        return [*batch.columns, ids, hit], [*batch.schema.names, "id", "chk"]

    if not spread and (spread is False or fits_broadcast(compiled)):
        table = {
            tuple(r[k] for k in keys): (np.array(r["_bounds"], float), np.array(r["_cells"]), r["_ids"])
            for r in compiled.toArrow().to_pylist()
        }
        shared = metrics.sparkSession.sparkContext.broadcast(table)

        def run(batches):
            known = shared.value
            for batch in batches:
                chosen = np.full(batch.num_rows, None, object)
                own = pa.table({k: batch.column(batch.schema.get_field_index(k)) for k in keys})
                own = own.append_column("_row", pa.array(np.arange(batch.num_rows)))
                values = batch.column(batch.schema.get_field_index(value))
                for group in own.group_by(keys).aggregate([("_row", "list")]).to_pylist():
                    cut = known.get(tuple(group[k] for k in keys))
                    if cut is not None:
                        at = np.array(group["_row_list"])
                        chosen[at] = matches(values.take(pa.array(at)), *cut)
                yield pa.RecordBatch.from_arrays(*judged(batch, chosen))

        return metrics.mapInArrow(run, out)

    left, right = salted_sides(metrics, compiled, keys, hot_rows=HOT_ROWS)
    # Rows without a key match nothing and no group of theirs is made.
    none = metrics.where(" or ".join(f"{k} is null" for k in keys))

    names = metrics.columns

    def meet(rows, cut):
        rows = rows.select(names).combine_chunks()
        chosen = np.full(rows.num_rows, None, object)
        if rows.num_rows and cut.num_rows:
            r = cut.to_pylist()[0]
            values = rows.column(value).combine_chunks()
            chosen = matches(values, np.array(r["_bounds"], float), np.array(r["_cells"]), r["_ids"])
        return pa.table(*judged(rows, chosen))

    by = [*keys, "_salt"]
    whole = left.where(" and ".join(f"{k} is not null" for k in keys)).select(*metrics.columns, "_salt")
    found = whole.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, out)
    return found.unionByName(none.withColumns({"id": F.lit(""), "chk": F.lit(0)}))


def any_match_intervals(metrics, rules, keys=KEYS, value="value", spread=None):
    """Metric rows for which some rule on their key holds, each row once, by the same search."""
    found = first_match_intervals(metrics, rules, keys, value, None, spread)
    return found.where("chk = 1").select(*metrics.columns)
