"""Durations, retention bounds and a total order over (time, sequence)."""

import re

from pyspark.sql import functions as F

_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def micros(duration):
    """'5 seconds' or '1 hour 30 minutes' as microseconds."""
    parts = re.findall(r"(\d+)\s*([a-z]+)", duration.lower())
    if not parts or re.sub(r"\d+\s*[a-z]+", "", duration.lower()).strip():
        raise ValueError(f"not a duration: {duration!r}")
    try:
        return sum(int(n) * _UNIT_MICROS[unit.rstrip("s")] for n, unit in parts)
    except KeyError as err:
        raise ValueError(f"not a fixed-length duration: {duration!r}") from err


def duration(us):
    """Microseconds as an interval string Spark's `window` accepts."""
    return f"{us} microseconds"


def epoch_micros(ts):
    """Microseconds since the epoch of a TIMESTAMP or (session zone) TIMESTAMP_NTZ."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _major(ts):
    """Time as the leading part of an `ordinal`; its factor exceeds the width of a long."""
    return epoch_micros(ts).cast("decimal(18,0)") * F.expr("20000000000000000000BD")


def ordinal(ts="ts", seq="seq"):
    """(ts, seq) packed into one DECIMAL(38, 0) that sorts the same way.

    `max_by(v, struct(ts, seq))` keeps a struct in its buffer, which forces a
    sort-based aggregate; a decimal keeps the aggregate hash-based. Years 1-9999 stay
    below 38 digits.
    """
    minor = F.coalesce(F.col(seq), F.lit(0)).cast("decimal(20,0)")
    return (_major(ts) + minor).cast("decimal(38,0)")


def sequence_of(position, ts="ts"):
    """The `seq` inside an `ordinal`, given its time."""
    return (F.col(position) - _major(ts)).cast("long")


def instant(as_of=None):
    """The moment a lookup is made: a given timestamp text or column, else now."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp_ntz")
    return as_of


def since(minutes, as_of=None):
    """Earliest time whose whole-second age at `as_of` is at most `minutes`.

    Ages are differences of whole seconds, so flooring `as_of` once gives the same
    rows as flooring both sides, and leaves the time column bare for pushdown.
    """
    return F.date_trunc("second", instant(as_of)) - F.make_dt_interval(mins=F.lit(minutes))


def recent(df, minutes, as_of=None, ts="ts"):
    """Rows no older than `minutes` at `as_of`."""
    bound = since(minutes, as_of).cast(df.schema[ts].dataType)
    return df.where(F.col(ts) >= bound)


def age_seconds(ts, as_of=None):
    """Whole-second age of a time column at `as_of`."""
    return F.unix_timestamp(instant(as_of).cast("timestamp")) - F.unix_timestamp(
        F.col(ts).cast("timestamp")
    )
