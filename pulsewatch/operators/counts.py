"""Counts over detections, rules and partitions."""

from pyspark.sql import functions as F

from pulsewatch.operators.ordered import running_sum


def detect_counts(checks):
    """Rows per metric and check outcome."""
    return checks.groupBy("metric", "chk").agg(F.count(F.lit(1)).alias("cnt"))


def batch_counts(checks, batch):
    """Per batch and metric: not detected, detected, and all rows."""
    return checks.groupBy(batch, "metric").agg(
        F.count_if(F.col("chk") == 0).alias("not_detected"),
        F.count_if(F.col("chk") == 1).alias("detected"),
        F.count(F.lit(1)).alias("batch_count"),
    )


def running_counts(counts, batch, limit=None):
    """Batch counts with the total of all rows up to and with their batch."""
    per_batch = counts.groupBy(batch).agg(F.sum("batch_count").alias("_rows"))
    totals = running_sum(per_batch, [], [batch], "_rows", "total_count", limit)
    return counts.join(totals.drop("_rows"), batch)


def rules_per_metric(rules):
    """Number of rules on each metric."""
    return rules.groupBy("metric").agg(F.count(F.lit(1)).alias("cnt"))


def partition_rows(df, n, *keys):
    """Rows per partition after hash partitioning by `keys`, empty partitions left out."""
    spread = df.repartition(n, *keys)
    return spread.groupBy(F.spark_partition_id().alias("partition_id")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def partitions_of_keys(df, n, *keys):
    """Per key: the hash partitions its rows lie in, and how many rows they are."""
    placed = df.repartition(n, *keys).withColumn("_p", F.spark_partition_id())
    return placed.groupBy(*keys).agg(
        (F.max("_p") - F.min("_p") + 1).cast("long").alias("partitions"), F.count(F.lit(1)).alias("cnt")
    )


def totals(df, value="value"):
    """All rows, and rows that have a value."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("with_value"))
