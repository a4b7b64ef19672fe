"""Messages to long-form metric, log, rule and alarm rows."""

from pyspark.sql import functions as F

from pulsewatch import schema


def _parsed(messages, declared):
    """Message fields as columns next to `received` and `seq`.

    The parsed value comes out of a generator, so that filters on its fields stay above
    the parser; pushed below, they would parse every message a second time.
    """
    body = F.inline(F.array(F.from_json("value", declared)))
    return messages.select(F.col("timestamp").alias("received"), "seq", body)


def _numeric(text):
    # Number parsing also takes a trailing type letter (12f, 1.5d), which is no JSON number.
    typed = F.lower(F.right(text, F.lit(1))).isin("d", "f")
    infinite = F.lower(text).isin("inf", "+inf", "-inf")
    return F.when(~typed | infinite, text.try_cast("double"))


def metrics(messages, sep=".", resource_tag="host", dc_tag="dc"):
    """Nested metric messages as one row per numeric field.

    Event time is the message's own timestamp, or else the time it was received. Text
    fields are left out without touching their numeric neighbours; a JSON null stays
    as a null value. Messages without a name and malformed ones are dropped here and
    are available from `rejected`.
    """
    data = _parsed(messages, schema.METRIC_MESSAGE).where("name is not null")
    fields = data.select(
        F.coalesce("timestamp", "received").alias("ts"),
        "seq",
        F.col("tags")[dc_tag].alias("dc"),
        F.col("tags")[resource_tag].alias("resource"),
        "name",
        F.explode("fields").alias("field", "text"),
    )
    number = _numeric(F.col("text"))
    return (
        fields.withColumn("value", number)
        .where(F.col("value").isNotNull() | F.col("text").isNull())
        .select(
            "ts",
            "seq",
            "dc",
            "resource",
            "name",
            F.concat("name", F.lit(sep), "field").alias("metric"),
            "value",
        )
    )


def rejected(messages):
    """Messages that `metrics` drops because they carry no metric name."""
    name = F.from_json("value", schema.METRIC_MESSAGE)["name"]
    return messages.where(name.isNull())


def flat_metrics(messages):
    """Flat metric messages in the same long form, timed by the message itself."""
    return (
        _parsed(messages, schema.FLAT_MESSAGE)
        .where("metric is not null")
        .select(
            F.col("received").alias("ts"),
            "seq",
            F.col("nodegroup").alias("dc"),
            "resource",
            F.col("metric").alias("name"),
            "metric",
            "value",
        )
    )


def logs(messages):
    """Event and log messages; a reading that is not a number becomes null."""
    return _parsed(messages, schema.LOG_MESSAGE).select(
        F.col("received").alias("ts"),
        "seq",
        "nodegroup",
        "resource",
        "event",
        _numeric(F.col("metric")).alias("metric"),
        "log",
    )


def rules(messages):
    """Rule change messages, without those that name no rule."""
    return (
        _parsed(messages, schema.RULE_MESSAGE)
        .where("id is not null")
        .select(
            F.col("id").alias("rule_id"),
            "resource",
            "metric",
            "op",
            F.col("value").alias("threshold"),
            F.col("received").alias("updated_at"),
            "seq",
        )
    )


def alarms(messages):
    """Alarm messages as columns, without those that name no alarm type.

    No repartitioning by rule here: the keyed operators that need it add their own
    exchange, and one hot rule would otherwise fill a single task for nothing.
    """
    return (
        _parsed(messages, schema.ALARM_MESSAGE)
        .where("alarmType is not null")
        .select(
            "received",
            "seq",
            F.col("alarmType").alias("alarm_type"),
            F.col("ruleId").alias("rule_id"),
            "detect",
            F.col("occurCount").alias("occur_count"),
            F.col("occurTimestamp").alias("occur_timestamp"),
            "payload",
        )
    )
