"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every query
runs once to warm up and then BENCH_RUNS times; the best run counts. Results go to the
`noop` sink, so a run computes all rows and collects none.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pandas as pd
from pyspark.sql import functions as F

from pulsewatch.operators import counts, detect
from pulsewatch.plans import catalog
from pulsewatch.plans.tables import metrics
from pulsewatch.session import build_session

HEADLINE = (
    "normalize_metrics",
    "threshold_detect",
    "first_match",
    "detect_counts",
    "dynamic_rule_join",
    "state_view",
    "rollup",
    "rollup_rule_detect",
    "sliding_count",
    "trailing_range",
    "continuous_alarm",
    "compound_rule",
    "last_in_window",
    "log_rule",
    "offset_as_of",
    "user_avg",
    "window_join_filter",
    "compound_mixed",
    "threshold_users",
    "state_view_users",
    "stream_detect",
    "stream_continuous",
    "stream_rollup",
    "stream_window_alarm",
)


def semi_join_then_check(spark, sf_dir):
    """Keep rows that have a rule first, then judge them."""
    rules = catalog.thresholds(spark)
    kept = detect.has_rule(metrics(spark, sf_dir), rules)
    return counts.detect_counts(detect.check(kept, rules))


def map_lookup_check(spark, sf_dir):
    """The same verdicts with the rules in a Python map that a pandas UDF looks into."""
    rules = {(r["resource"], r["metric"]): (r["op"], r["threshold"]) for r in catalog.THRESHOLDS}
    holds = {
        "=": lambda v, t: v == t, ">": lambda v, t: v > t, ">=": lambda v, t: v >= t,
        "<": lambda v, t: v < t, "<=": lambda v, t: v <= t, "!=": lambda v, t: v != t, "<>": lambda v, t: v != t,
    }

    @F.pandas_udf("int")
    def look_up(resource: pd.Series, metric: pd.Series, value: pd.Series) -> pd.Series:
        out = pd.Series(None, index=value.index, dtype="Int32")
        keys = pd.Series(list(zip(resource, metric)), index=value.index)
        for key, (op, threshold) in rules.items():
            mine = keys == key
            out[mine] = holds.get(op, lambda v, t: v != v)(value[mine], threshold).astype("Int32")
        return out

    checked = metrics(spark, sf_dir).withColumn("chk", look_up("resource", "metric", "value"))
    return counts.detect_counts(checked.where("chk is not null"))


VARIANTS = {"join_semi_first": semi_join_then_check, "join_python_map": map_lookup_check}


def run(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "pulsewatch-bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: catalog.QUERIES[name] for name in HEADLINE} | VARIANTS
    seconds = {}
    for name, query in queries.items():
        run(query, spark, sf_dir)
        seconds[name] = round(min(run(query, spark, sf_dir) for _ in range(runs)), 3)
    rows = metrics(spark, sf_dir).count()
    line = {
        "metric": "headline queries, best of runs, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "metric_rows": rows,
        "rows_per_sec": {n: int(rows / seconds[n]) for n in ("threshold_detect", "state_view", "rollup", "continuous_alarm")},
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
