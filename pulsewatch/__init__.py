"""Metric monitoring on Spark: normalise, match rules, keep views, raise alarms."""
