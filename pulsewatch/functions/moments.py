"""Count, mean, spread and extremes as partials that merge without loss."""

from pyspark.sql import functions as F


def partial_moments(value="value"):
    """Aggregates that describe a set of values and can be merged later."""
    v = F.col(value)
    return [
        F.count(v).alias("cnt"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def sample_stddev(cnt="cnt", m2="m2"):
    """Sample standard deviation from a count and squared deviations; NULL below two."""
    return F.when(F.col(cnt) > 1, F.sqrt(F.col(m2) / (F.col(cnt) - 1)))


def merge_moments(partials, keys, *more):
    """One row per key from any number of partials of that key.

    Deviations are taken from the key's own mean, so large values with little spread keep
    their precision: one hash aggregate finds the means, which are joined back, and a second
    one sums up; both combine before they shuffle, so no key has to fit a task. `more` are
    further aggregates of the same groups.
    """
    keys = list(keys)
    weight = F.sum(F.col("cnt") * F.col("mean")) / F.nullif(F.sum("cnt"), F.lit(0))
    means = partials.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(weight.alias("_c"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    centred = partials.join(means, same)
    gap = F.col("mean") - F.col("_c")
    return centred.groupBy(*keys).agg(
        F.sum("cnt").alias("cnt"),
        F.max("_c").alias("mean"),
        F.sum(F.col("m2") + F.col("cnt") * gap * gap).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        *more,
    )
