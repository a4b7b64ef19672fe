"""Continuous alarms on a stream out of order, with rows put in order in keyed state.

Detections wait in the state of their rule until the watermark has passed them. A timer then
takes them out in the full order of `continuous_alarms`, goes on with the rule's run, and emits
each row with the run it ends. So the answer does not depend on where micro-batches end or on the
order of arrival within the delay. State is kept in RocksDB and comes back after a restart. Rows
wait in packs of many, not one by one, and are sorted and counted as arrays.
"""

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pulsewatch.functions.times import epoch_micros, micros
from pulsewatch.operators.continuous import ORDER, continuous_form
from pulsewatch.operators.rulebook import rules_of_kind
from pulsewatch.sources.tables import batch_folder
from pulsewatch.streaming.live import ALARM_COLUMNS, as_alarms, per_batch, version
from pulsewatch.streaming.streaks import full_order

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "pack binary"
PACK_ROWS = 10_000
#: Null sequences and null or NaN values are told by flags, as a data frame keeps neither apart.
PACKED = pa.schema(
    [
        pa.field("at", pa.int64()),
        pa.field("has_seq", pa.bool_()),
        pa.field("seq", pa.int64()),
        pa.field("metric", pa.string()),
        pa.field("kind", pa.int32()),
        pa.field("value", pa.float64()),
        pa.field("detect", pa.bool_()),
    ]
)
NULL, NUMBER, NAN = 0, 1, 2
COUNTED = (
    "rule_id string, at long, has_seq boolean, seq long, metric string, kind int, value double, detect boolean, streak long"
)


def null_first(x):
    """A key that sorts like Spark: null first, NaN above every number."""
    if x is None:
        return 0, 0
    return (2, 0) if x != x else (1, x)


def flagged(detections):
    kind = F.when(F.col("value").isNull(), NULL).when(F.isnan("value"), NAN).otherwise(NUMBER)
    return detections.withColumns(
        {
            "has_seq": F.col("seq").isNotNull(),
            "seq": F.coalesce("seq", F.lit(0)),
            "kind": kind,
            "value": F.when(kind == NUMBER, F.col("value")).otherwise(0.0),
        }
    )


def unflagged(counted):
    value = F.when(F.col("kind") == NUMBER, F.col("value")).when(F.col("kind") == NAN, F.lit(float("nan")))
    return counted.withColumns({"seq": F.when(F.col("has_seq"), F.col("seq")), "value": value})


def packs(rows):
    """A table of rows as Arrow streams of at most `PACK_ROWS`."""
    for low in range(0, rows.num_rows, PACK_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, PACKED) as out:
            out.write_table(rows.slice(low, PACK_ROWS))
        yield sink.getvalue().to_pybytes()


def unpacked(found):
    return pa.concat_tables([PACKED.empty_table(), *(pa.ipc.open_stream(p).read_all() for p in found)])


def in_order(rows):
    """The rows of a rule in their full order; of equal ones those that do not detect come first."""
    names = rows.column("metric").to_pylist()
    rank = {m: n for n, m in enumerate(sorted(set(names), key=null_first))}
    column = {c: rows.column(c).to_numpy() for c in PACKED.names if c != "metric"}
    column["metric"] = np.fromiter(map(rank.get, names), np.int64, len(names))
    return rows.take(np.lexsort([column[c] for c in reversed(PACKED.names)]))


def run_lengths(detect, at, length, last, idle=None):
    """The run each of some rows in order ends, after a run of `length` whose last row was at `last`."""
    place = np.arange(len(at))
    anew = np.full(len(at), -1 - length)
    if idle is not None:
        anew = np.where(np.diff(at, prepend=last) > idle, place - 1, anew)
    # The place of the last row that is not in the run.
    return place - np.maximum.accumulate(np.where(detect, anew, place))


class OrderedRuns(StatefulProcessor):
    """Per rule: rows that wait for the watermark, the length of its run and the time of its last row."""

    def __init__(self, idle=None):
        self.idle = idle

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.run = handle.getValueState("run", "length long, last long")

    def handleInputRows(self, key, rows, timerValues):
        first = []
        for part in rows:
            first.append(self.keep(pa.Table.from_pandas(part[PACKED.names], PACKED, preserve_index=False)))
        self.wake(min(first))
        return iter(())

    def keep(self, rows):
        """Let rows wait; the time of the first."""
        for pack in packs(rows):
            self.waiting.appendValue((pack,))
        return int(rows.column("at").to_numpy().min())

    def wake(self, at):
        """A timer for when the watermark (in milliseconds) has passed a time (in microseconds)."""
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = unpacked(bytes(pack) for (pack,) in self.waiting.get())
        ready = rows.column("at").to_numpy() <= passed
        known = self.run.get() if self.run.exists() else None
        if not ready.any():
            # All rows to come are later still, and start a run anew.
            if self.idle is not None and known is not None and known[1] + self.idle <= passed:
                self.run.clear()
            return
        self.waiting.clear()
        if not ready.all():
            self.wake(self.keep(rows.filter(pa.array(~ready))))
        rows = in_order(rows.filter(pa.array(ready)))
        at = rows.column("at").to_numpy()
        length, last = (0, int(at[0])) if known is None else known
        streak = run_lengths(rows.column("detect").to_numpy(), at, length, last, self.idle)
        for low in range(0, len(at), PACK_ROWS):
            part = rows.slice(low, PACK_ROWS).to_pandas()
            part.insert(0, "rule_id", pd.Series([key[0]] * len(part), dtype=object))
            yield part.assign(streak=streak[low : low + PACK_ROWS])
        self.run.update((int(streak[-1]), int(at[-1])))
        if self.idle is not None:
            self.wake(int(at[-1]) + self.idle)

    def close(self):
        pass


def use_state_store(spark):
    """Keyed state needs the RocksDB store; its processor is sent to the workers by value."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ordered_runs(detections, delay, idle=None):
    """A stream of detections (rule_id, detect, occur_timestamp, seq, metric, value) with `streak`,
    the length of the run each row ends (0 where it does not detect), in order per rule.

    Rows are counted when the watermark, `delay` behind the newest detection, has passed them;
    rows that come later than that are dropped, as by any watermark. With `idle` a run ends with a
    gap longer than that, and a rule without a row in that time is forgotten, so state does not
    grow with rules that are gone. The rows of one rule that wait have to fit a task's memory: those of one delay.
    """
    use_state_store(detections.sparkSession)
    placed = full_order(detections).withColumn("at", epoch_micros("occur_timestamp")).withWatermark("occur_timestamp", delay)
    columns = ["rule_id", "occur_timestamp", *PACKED.names]
    processor = OrderedRuns(None if idle is None else micros(idle))
    grouped = flagged(placed).select(*columns).groupBy("rule_id")
    counted = unflagged(grouped.transformWithStateInPandas(processor, COUNTED, "Append", "EventTime"))
    return counted.withColumn("occur_timestamp", F.timestamp_micros("at")).select("rule_id", "detect", *ORDER, "streak")


def start_continuous_state(detections, load_rules, alarms_path, checkpoint, delay, idle=None, **options):
    """Continuous alarms from a stream of detections that are out of order by up to `delay`.

    Alarms have the form of detections' and are written by batch. Rules are read anew per
    micro-batch; runs are counted for every rule, so one added later sees the run so far.
    """

    def handle(batch, batch_id):
        with version(load_rules, batch_id) as rules:
            counted = batch.withColumnRenamed("rule_id", "target_rule_id")
            alarms = continuous_form(counted, rules_of_kind(rules, "continuous"))
            batch_folder(as_alarms(alarms).select(*ALARM_COLUMNS), alarms_path, batch_id)

    return per_batch(ordered_runs(detections, delay, idle), handle, checkpoint, **options)
