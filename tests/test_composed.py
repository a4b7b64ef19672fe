import datetime as dt
import random

from conftest import METRICS, rows
from pyspark.sql import functions as F

from pulsewatch.operators import cep
from pulsewatch.streaming import composed

T0 = dt.datetime(2024, 1, 1)
L = cep.Leaf
RULES = {"r1": (L("a") & L("b")) | L("c"), "r2": L("c") | L("d"), "r3": L("d") & L("a"), "r4": L("e") & L("b")}
LEAVES = [
    {"leaf_id": n, "resource": r, "metric": "m", "op": ">", "threshold": 5.0, "value": v}
    for n, r, v in (("a", "s1", None), ("b", "s2", None), ("c", "s1", None), ("d", "never", None), ("e", "s3", 9.0))
]


def batches(seed, n=5):
    pick = random.Random(seed)
    return [
        [(T0 + dt.timedelta(seconds=20 * b + pick.randint(0, 30)), 100 * b + i, f"s{pick.randint(1, 4)}", "m", pick.choice([1.0, 9.0, None])) for i in range(pick.randint(0, 6))]
        for b in range(n)
    ]


def test_changes_add_up_to_the_verdicts_over_all_rows(spark, tmp_path, monkeypatch):
    leaves, nodes = cep.leaf_frame(spark, LEAVES), cep.node_frame(spark, *RULES.items())
    values, verdicts = composed.value_table(spark, f"{tmp_path}/values"), composed.verdict_table(spark, f"{tmp_path}/verdicts")
    folded = []
    plain = composed.evaluate
    monkeypatch.setattr(composed, "evaluate", lambda some, found: folded.append({r.rule_id for r in some.select("rule_id").collect()}) or plain(some, found))
    seen, now = [], {}
    for n, batch in enumerate(batches(3)):
        seen += batch
        came, changed = composed.composed_changes(spark.createDataFrame(batch, METRICS), leaves, nodes, values, verdicts, n)
        got = changed.collect()
        assert all(r["was"] == now.get(r["rule_id"]) for r in got)
        assert n == 0 or all(r["result"] != r["was"] for r in got)
        now.update({r["rule_id"]: r["result"] for r in got})
        values.write(came, n)
        verdicts.write(changed.select("rule_id", "result", F.lit(n).cast("long").alias("batch_id")), n)
        whole = cep.evaluate(nodes, cep.value_leaves(leaves, spark.createDataFrame(seen, METRICS)))
        assert now == dict(map(tuple, whole.collect()))
    assert folded[0] == set(RULES) and any(len(f) < len(RULES) for f in folded[1:])


def test_a_late_value_changes_nothing(spark, tmp_path):
    leaves, nodes = cep.leaf_frame(spark, LEAVES), cep.node_frame(spark, ("r", L("a") | L("c")))
    values, verdicts = composed.value_table(spark, f"{tmp_path}/values"), composed.verdict_table(spark, f"{tmp_path}/verdicts")
    for n, (at, value, expected) in enumerate([(10, 9.0, [("r", True, None)]), (5, 1.0, []), (20, 1.0, [("r", False, True)])]):
        batch = spark.createDataFrame([(T0 + dt.timedelta(seconds=at), n, "s1", "m", value)], METRICS)
        came, changed = composed.composed_changes(batch, leaves, nodes, values, verdicts, n)
        assert rows(changed) == expected
        values.write(came, n)
        verdicts.write(changed.select("rule_id", "result", F.lit(n).cast("long").alias("batch_id")), n)


def test_a_retried_batch_is_not_judged_twice(spark, tmp_path):
    leaves, nodes = cep.leaf_frame(spark, LEAVES), cep.node_frame(spark, *RULES.items())
    data = spark.createDataFrame([r for b in batches(5) for r in b], METRICS)
    data.write.parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        composed.start_composed(files, leaves, nodes, f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
        # The checkpoint forgets the batch, as if the process had ended before it was settled.
        for f in (tmp_path / "checkpoint" / "commits").glob("*0*"):
            f.unlink()
    found = spark.read.parquet(f"{tmp_path}/out/changes")
    assert found.count() == len(RULES)
