"""Rule tables: read, declared in place, and changed by appending."""

import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pulsewatch import schema
from pulsewatch.operators.rulebook import current_rules, rules_of_kind

_BODY = [
    f.name for f in schema.RULES.fields if f.name not in ("rule_id", "updated_at", "seq", "deleted")
]


def rules_frame(spark, rules):
    """Rules given as dicts, as a rule table; columns not named are null."""
    names = schema.RULES.fieldNames()
    for rule in rules:
        unknown = set(rule) - set(names)
        if unknown:
            raise ValueError(f"unknown rule columns {sorted(unknown)}")
    return small_frame(spark, [[rule.get(n) for n in names] for rule in rules], schema.RULES)


def small_frame(spark, rows, declared):
    """Rows of the driver as a local relation: no job, whatever the cluster's parallelism."""
    columns = to_arrow_schema(declared)
    arrays = [
        pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(columns)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=columns), declared)


def load_rules(spark, path=None, fmt="parquet", json_column=None, **options):
    """All rules of a store: a table of rules, or of JSON texts that hold one rule each."""
    reader = spark.read.format(fmt).options(**options)
    if json_column is None and fmt == "json":
        reader = reader.schema(schema.RULES)
    df = reader.load(path) if path else reader.load()
    if json_column is None:
        return df
    rule = F.from_json(json_column, schema.RULE_MESSAGE)
    return (
        df.select(rule.alias("r"))
        .where("r.resource is not null and r.metric is not null")
        .select(
            F.coalesce("r.id", F.concat_ws(":", "r.resource", "r.metric")).alias("rule_id"),
            "r.resource",
            "r.metric",
            F.coalesce("r.op", F.lit(">")).alias("op"),
            F.col("r.value").alias("threshold"),
        )
    )


class RuleBook:
    """A rule table in a folder, changed only by appending.

    Each change is a row; the last one per rule counts, so adding a rule that exists
    replaces it and a running stream sees a change with its next batch.
    """

    def __init__(self, spark, path):
        self.spark = spark
        self.path = path

    def _append(self, df):
        stamp = F.timestamp_micros(F.lit(time.time_ns() // 1000))
        changes = df.withColumn("updated_at", stamp).withColumn("seq", F.monotonically_increasing_id())
        changes.select(*schema.RULES.fieldNames()).write.mode("append").parquet(self.path)

    def put(self, *rules):
        """Add rules, or replace those with the same id; a later argument wins."""
        rows = rules_frame(self.spark, [{**r, "deleted": False} for r in rules])
        self._append(rows.coalesce(1))

    add = update = put

    def remove(self, *rule_ids):
        """Take rules out of force."""
        self._append(
            rules_frame(self.spark, [{"rule_id": r, "deleted": True} for r in rule_ids]).coalesce(1)
        )

    def clear(self):
        """Take all rules out of force."""
        gone = self.current().select("rule_id")
        empty = [
            F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.RULES.fields
            if f.name not in ("rule_id", "deleted")
        ]
        self._append(gone.select("rule_id", *empty, F.lit(True).alias("deleted")))

    def history(self):
        """Every change made; none where nothing was written yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return small_frame(self.spark, [], schema.RULES)
        return self.spark.read.schema(schema.RULES).parquet(self.path)

    def current(self, *kinds):
        """Rules in force, all or of some kinds."""
        rules = current_rules(self.history(), _BODY)
        return rules_of_kind(rules, *kinds) if kinds else rules
