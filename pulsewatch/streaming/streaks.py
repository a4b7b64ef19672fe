"""Continuous alarms on a stream, with the run every rule is in carried from batch to batch.

A micro-batch is worked out by the batch operator; one row per rule carries on the length of
its run and its last row. The carry is stored under the batch's number before the batch
counts as done, so a batch that is tried again starts from the same carry.
"""

from pyspark.sql import functions as F

from pulsewatch.operators.continuous import ORDER, continuous_form, streak_rows
from pulsewatch.operators.rulebook import rules_of_kind
from pulsewatch.operators.sizing import keyed_join
from pulsewatch.sources.tables import batch_folder, numbered_folders, remove_folder
from pulsewatch.streaming.live import ALARM_COLUMNS, as_alarms, per_batch, version

CARRY = "rule_id string, run long, last struct<occur_timestamp:timestamp,seq:long,metric:string,value:double>"
LATE = "rule_id string, detect boolean, occur_timestamp timestamp, seq long, metric string, value double"


def full_order(detections):
    """Detections in the columns runs are counted by; those a source lacks are null."""
    missing = {"metric": "string", "value": "double"}
    full = detections.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in detections.columns})
    held = F.coalesce("detect", F.lit(False)).alias("detect")
    return full.select("rule_id", held, F.col("occur_timestamp").cast("timestamp").alias("occur_timestamp"), *ORDER[1:])


def carried_streaks(batch, carry, limit=None):
    """(rows with their `streak`, the next carry, rows that came too late) of one micro-batch.

    Rows at or after the last counted one of their rule go on with its run; equal rows count
    each, as in one batch over all. Rows before it are late: their place in the run is past.
    """
    place = F.struct(*ORDER)
    known = keyed_join(full_order(batch), carry, ["rule_id"], "left")
    late = F.col("last").isNotNull() & (place < F.col("last"))
    on_time = known.where(~late)
    counted = streak_rows(on_time, ORDER, limit)
    breaks = on_time.groupBy("rule_id").agg(
        F.min(F.when(~F.col("detect"), place)).alias("_first"),
        F.max(F.when(~F.col("detect"), place)).alias("_break"),
        F.max(place).alias("_last"),
    )
    marked = keyed_join(counted, breaks, ["rule_id"])
    unbroken = F.col("_first").isNull() | (place < F.col("_first"))
    # Of equal rows with and without a detection those without come first.
    goes_on = unbroken & F.col("detect")
    marked = marked.withColumn("streak", F.col("streak") + F.when(goes_on, F.coalesce("run", F.lit(0))).otherwise(0))
    ends = marked.groupBy("rule_id").agg(
        F.count_if(F.col("_break").isNull() | (place > F.col("_break")) | ((place == F.col("_break")) & F.col("detect"))).alias("_tail"),
        F.first("_last").alias("last"),
        F.first(F.col("_break").isNull()).alias("_whole"),
        F.first(F.coalesce("run", F.lit(0))).alias("_run"),
    )
    grown = ends.select("rule_id", (F.col("_tail") + F.when(F.col("_whole"), F.col("_run")).otherwise(0)).alias("run"), "last")
    kept = carry.join(grown.select("rule_id"), "rule_id", "left_anti")
    return (
        marked.select("rule_id", "detect", *ORDER, "streak"),
        grown.unionByName(kept),
        known.where(late).select("rule_id", "detect", *ORDER),
    )


def start_continuous_alarms(detections, load_rules, alarms_path, checkpoint, **options):
    """Continuous alarms from a stream of detections; rules are read anew per micro-batch.

    Runs are counted for every rule, so a continuous rule added later sees the run so far.
    Alarms have the form of detections' (`live.ALARMS`), so that further rules can watch them.
    Late rows go to `{alarms_path}-late`, by batch: with them and the counted ones the batch
    operator gives the answer over all rows.
    """
    spark = detections.sparkSession
    runs, late_path = f"{checkpoint.rstrip('/')}-runs", f"{alarms_path.rstrip('/')}-late"

    def carry_before(batch_id):
        done = [n for n in numbered_folders(spark, runs) if n < batch_id]
        reader = spark.read.schema(CARRY)
        return reader.parquet(f"{runs}/batch_id={done[-1]}") if done else spark.createDataFrame([], CARRY)

    def handle(batch, batch_id):
        known = batch.persist()
        try:
            counted, carry, late = carried_streaks(known, carry_before(batch_id))
            counted = counted.withColumnRenamed("rule_id", "target_rule_id").persist()
            try:
                with version(load_rules, batch_id) as rules:
                    alarms = continuous_form(counted, rules_of_kind(rules, "continuous"))
                    batch_folder(as_alarms(alarms).select(*ALARM_COLUMNS), alarms_path, batch_id)
                batch_folder(late, late_path, batch_id)
                # Last, as it settles the batch: until then a retry starts from the carry before.
                batch_folder(carry, runs, batch_id)
            finally:
                counted.unpersist()
        finally:
            known.unpersist()
        for n in numbered_folders(spark, runs):
            if n < batch_id - 1:
                remove_folder(spark, f"{runs}/batch_id={n}")

    return per_batch(detections, handle, checkpoint, **options)
