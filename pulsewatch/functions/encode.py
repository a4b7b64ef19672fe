"""JSON encodings of alarms and their payloads."""

from pyspark.sql import functions as F

# JSON field names of an encoded alarm.
ALARM_FIELDS = {
    "alarmType": "alarm_type",
    "ruleId": "rule_id",
    "detect": "detect",
    "occurCount": "occur_count",
    "occurTimestamp": "occur_timestamp",
    "payload": "payload",
}


# JSON keeps milliseconds unless told otherwise, which would make alarms tie.
TO_MICROS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def encode_alarm():
    """An alarm row as the JSON text of a message value."""
    columns = {f: F.col(c) for f, c in ALARM_FIELDS.items()}
    columns["occurTimestamp"] = columns["occurTimestamp"].cast("timestamp")
    return F.to_json(F.struct(*[c.alias(f) for f, c in columns.items()]), TO_MICROS)


def metric_rule_payload(metric_columns, rule_columns):
    """JSON with the metric row and the rule that looked at it, nested under their names."""
    return F.to_json(
        F.struct(
            F.struct(*[c.alias(n) for n, c in metric_columns.items()]).alias("metric"),
            F.struct(*[c.alias(n) for n, c in rule_columns.items()]).alias("rule"),
        ),
        TO_MICROS,
    )


def rule_payload(rule_columns):
    """JSON `{"rule": {...}}` of one rule."""
    return F.to_json(F.struct(F.struct(*[c.alias(n) for n, c in rule_columns.items()]).alias("rule")))
