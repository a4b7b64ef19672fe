"""Message streams as (timestamp, key, value, seq)."""

from pyspark.sql import functions as F

MESSAGE = "timestamp timestamp, key string, value string"


def _shaped(df, fmt):
    if fmt == "kafka":
        # Offsets order the messages of one partition, and a key stays in one partition.
        return df.selectExpr(
            "timestamp", "cast(key as string) as key", "cast(value as string) as value", "offset as seq"
        )
    wanted = ["timestamp", "key", "value"]
    if "seq" in df.columns:
        return df.select(*wanted, "seq")
    # A hash of the content orders equal timestamps the same way on every run.
    return df.select(*wanted, F.xxhash64("key", "value").alias("seq"))


def kafka_options(servers, topic, start="latest", max_per_trigger=None, fail_on_data_loss=None, **more):
    """Options of a Kafka source: start position, rate limit, and what to do on lost data."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if fail_on_data_loss is not None:
        options["failOnDataLoss"] = str(fail_on_data_loss).lower()
    return {**options, **more}


def read_messages(spark, fmt="kafka", path=None, schema=MESSAGE, stream=True, **options):
    """Messages from Kafka, or from files (`parquet`, `json`, ...) with the same columns.

    Files take `maxFilesPerTrigger` as their rate limit.
    """
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    if fmt != "kafka":
        reader = reader.schema(schema)
    return _shaped(reader.load(path) if path else reader.load(), fmt)
