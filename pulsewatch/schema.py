"""Declared schemas of the messages and tables the library reads and writes."""

from pyspark.sql import types as T

# Field names and types of the JSON messages, as producers send them.
# Numeric fields arrive as text so that one bad field does not null the whole map.
METRIC_MESSAGE = "name string, tags map<string,string>, fields map<string,string>, timestamp timestamp"
FLAT_MESSAGE = "nodegroup string, resource string, metric string, value double, timestamp timestamp"
LOG_MESSAGE = "nodegroup string, metric string, resource string, event string, log string"
RULE_MESSAGE = "id string, resource string, metric string, value double, op string"
ALARM_MESSAGE = (
    "alarmType string, ruleId string, detect boolean, occurCount int, "
    "occurTimestamp timestamp, payload string"
)

# Columns every operator expects of a long-form metric frame. `seq` orders rows
# that share a timestamp, so that "latest" and streaks are deterministic.
METRIC_COLUMNS = ("ts", "seq", "dc", "resource", "name", "metric", "value")

# One row per rule (or, in a rule history, one row per change of a rule).
RULES = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("summary", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("target_rule_id", T.StringType()),
        T.StructField("mark_count", T.LongType()),
        T.StructField("window", T.StringType()),
        T.StructField("slide", T.StringType()),
        T.StructField("agg", T.StringType()),
        T.StructField("dc", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)

RULE_KINDS = ("threshold", "state", "rollup", "log", "continuous", "window", "range")

PROGRESS = "query string, batch_id long, ts timestamp, start_offset string"
