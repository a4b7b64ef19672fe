"""Rule predicates as Column expressions (never spliced SQL text)."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The comparison operators a rule may name.
OPERATORS = ("=", ">", ">=", "<", "<=", "!=", "<>")

# The summaries of a rollup a rule may test.
SUMMARIES = ("mean", "min", "max", "cnt", "stddev")


def _as_column(x):
    return x if isinstance(x, Column) else F.lit(x)


def compare_or_null(value, op, threshold):
    """`value op threshold`; NULL when the value is missing or the operator unknown."""
    value, op, threshold = _as_column(value), _as_column(op), _as_column(threshold)
    return (
        F.when(op == "=", value == threshold)
        .when(op == ">", value > threshold)
        .when(op == ">=", value >= threshold)
        .when(op == "<", value < threshold)
        .when(op == "<=", value <= threshold)
        .when(op.isin("!=", "<>"), value != threshold)
    )


def compare(value, op, threshold):
    """`value op threshold`, false when the value is missing or the operator unknown.

    Spark orders NaN above every number, so a NaN value meets a `>` rule.
    """
    return F.coalesce(compare_or_null(value, op, threshold), F.lit(False))


def key_match(resource, metric):
    """Rows of exactly one metric of one resource."""
    return (F.col("resource") == resource) & (F.col("metric") == metric)


def threshold_condition(resource, metric, op, threshold, value="value"):
    """One threshold rule as a row predicate: its key and its comparison."""
    return key_match(resource, metric) & compare(F.col(value), op, threshold)


def rollup_condition(resource, metric, summary, op, threshold):
    """One rollup rule as a predicate on rollup rows."""
    return key_match(resource, metric) & compare(summary_value(F.lit(summary)), op, threshold)


def summary_value(summary, columns=None):
    """The summary a rule asks for, chosen per row from the rollup's columns."""
    columns = columns or {name: name for name in SUMMARIES}
    chosen = F.lit(None).cast("double")
    for name, column in columns.items():
        chosen = F.when(summary == name, F.col(column).cast("double")).otherwise(chosen)
    return chosen


def log_condition(log, op, keyword):
    """Log rule: `=`, `!=` or `like`; the keyword is literal text, not a pattern."""
    log, op, keyword = _as_column(log), _as_column(op), _as_column(keyword)
    hit = (
        F.when(op == "=", log == keyword)
        .when(op == "!=", log != keyword)
        .when(op == "like", F.contains(log, keyword))
    )
    return F.coalesce(hit, F.lit(False))


def raw_condition(text):
    """A caller's own SQL condition."""
    return F.expr(text)


@dataclass(frozen=True)
class FilterGroup:
    """Filters joined by one connective; groups nest, and `add` returns a longer group."""

    logic: str = "AND"
    terms: tuple = field(default_factory=tuple)

    def add(self, term):
        return FilterGroup(self.logic, (*self.terms, term))

    def condition(self):
        if self.logic not in ("AND", "OR"):
            raise ValueError(f"unknown connective {self.logic!r}")
        columns = [t.condition() if isinstance(t, FilterGroup) else t for t in self.terms]
        if not columns:
            return F.lit(False)
        if self.logic == "AND":
            return reduce(lambda a, b: a & b, columns)
        return reduce(lambda a, b: a | b, columns)
