import math
import random

import numpy as np
import pytest
from conftest import rows

from pulsewatch.operators import detect, intervals

METRIC_ROWS = "resource string, metric string, value double, seq long"
ORDERED = "rule_id string, resource string, metric string, op string, threshold double, rule_order long"
OPS = ["=", ">", ">=", "<", "<=", "!=", "<>", "~", None]
VALUES = [-1.0, 0.0, -0.0, 0.5, 1.0, 2.0, math.inf, -math.inf, math.nan, None]


def told(df):
    """Rows with NaN as a text, so that they compare."""
    return sorted(tuple(map(repr, r)) for r in rows(df))


def holds(value, op, threshold):
    if value is None or threshold is None:
        return False
    above = (math.isnan(value), value if not math.isnan(value) else 0) > (math.isnan(threshold), threshold if not math.isnan(threshold) else 0)
    same = value == threshold or (math.isnan(value) and math.isnan(threshold))
    return {"=": same, ">": above, ">=": above or same, "<": not above and not same, "<=": not above, "!=": not same, "<>": not same}.get(op, False)


@pytest.mark.parametrize("seed", range(30))
def test_sweep_finds_the_first_rule_of_every_value(seed):
    pick = random.Random(seed)
    rules = [(pick.choice(OPS[:7]), pick.choice(VALUES[:9])) for _ in range(pick.randint(0, 9))]
    bounds, cells = intervals.sweep(np.array([t for _, t in rules], float), np.array([o for o, _ in rules], object))
    for value in VALUES[:9] + [0.25, 1.5, 3.0]:
        first = next((i for i, (o, t) in enumerate(rules) if holds(value, o, t)), -1)
        assert cells[intervals.cells_of(bounds, np.array([value]))[0]] == first, (rules, value)


def tables(spark, seed, n=300, k=60):
    pick = random.Random(seed)
    key = lambda: (pick.choice(["hot", "hot", "b", None]), pick.choice(["m", "n"]))
    data = [(*key(), pick.choice(VALUES), i % 200) for i in range(n)]
    rules = [(f"r{i}", *key(), pick.choice(OPS), pick.choice(VALUES), pick.randint(0, 20)) for i in range(k)]
    return spark.createDataFrame(data, METRIC_ROWS), spark.createDataFrame(rules, ORDERED)


@pytest.mark.parametrize("spread", [False, True])
def test_same_rows_as_the_list_of_rules(spark, monkeypatch, spread):
    monkeypatch.setattr(intervals, "HOT_ROWS", 20)
    data, rules = tables(spark, 4)
    want = detect.first_match(data, rules, spread=False)
    found = intervals.first_match_intervals(data, rules, spread=spread)
    assert found.columns == want.columns
    assert told(found) == told(want)
    every = intervals.any_match_intervals(data, rules, spread=spread)
    assert told(every) == told(detect.any_rule_matches(data, rules))


def test_no_rules_and_no_rows(spark):
    data, rules = tables(spark, 5, 20)
    assert {r.chk for r in intervals.first_match_intervals(data, rules.limit(0)).collect()} == {0}
    for spread in (False, True):
        assert intervals.first_match_intervals(data.limit(0), rules, spread=spread).collect() == []


def test_lookups_do_not_grow_with_the_rules():
    """A search of a million cells compares about twenty of them."""
    thresholds = np.arange(500_000.0)
    bounds, cells = intervals.sweep(thresholds, np.full(500_000, "="))
    assert len(cells) == 1_000_001
    assert cells[intervals.cells_of(bounds, np.array([77.0, 77.5]))].tolist() == [77, -1]
