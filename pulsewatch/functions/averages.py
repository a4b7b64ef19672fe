"""A user-defined average, as a partial aggregate and as a SQL function."""

import sys

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def user_avg(df, keys, value, name="user_avg"):
    """User-defined average with a map-side partial step.

    `update` runs in Python over Arrow batches and leaves one (count, sum) buffer
    per key and batch; `merge` and `evaluate` are ordinary aggregates. No group is
    ever gathered in one Python task.
    """
    keys = list(keys)
    slim = df.select(*keys, F.col(value).cast("double").alias("_v"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keys]
    schema = ", ".join([*fields, "_n long", "_s double"])

    def update(batches):
        for batch in batches:
            grouped = pa.Table.from_batches([batch]).group_by(keys)
            buffers = grouped.aggregate([("_v", "count"), ("_v", "sum")])
            columns = [buffers[c] for c in (*keys, "_v_count", "_v_sum")]
            yield from pa.table(columns, names=[*keys, "_n", "_s"]).combine_chunks().to_batches()

    merged = slim.mapInArrow(update, schema).groupBy(*keys)
    evaluate = F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))
    return merged.agg(evaluate.alias(name))


class UpdateAverage:
    """Table function: the rows of one key and salt, one at a time, to one (key, count, sum) buffer."""

    def __init__(self):
        self.key, self.n, self.s = None, 0, 0.0

    def eval(self, row: Row):
        self.key = row["key"]
        if row["value"] is not None:
            self.n += 1
            self.s += row["value"]

    def terminate(self):
        yield self.key, self.n, self.s


def user_avg_sql(spark, table, key, value, name="user_avg", salts=32):
    """The average in SQL, in two levels: a table function makes a buffer per key and salt, holding
    one row at a time, and ordinary sums merge the buffers. A key is spread over `salts` tasks."""
    spark.udtf.register("user_avg_update", F.udtf(UpdateAverage, returnType="key string, n long, s double"))
    rows = f"SELECT CAST({key} AS STRING) AS key, CAST({value} AS DOUBLE) AS value, CAST(rand(7) * {salts} AS INT) AS salt FROM {table}"
    return spark.sql(
        f"""SELECT key AS {key}, sum(s) / nullif(sum(n), 0) AS {name}
            FROM user_avg_update(TABLE({rows}) PARTITION BY (key, salt)) GROUP BY key"""
    )


def register_user_avg(spark, name="user_avg"):
    """Register the average for SQL text. A group is one Python task: small groups only."""

    @F.pandas_udf("double")
    def average(values: pd.Series) -> float:
        return values.mean()

    return spark.udf.register(name, average)
