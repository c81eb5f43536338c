"""Scalar column functions (all built-in expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockcast.config import PROPERTY_TYPE

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
# Fixed value: the ISO-8601 UTC layout the history feeds use.
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Q9: every timestamp is a wall-clock UTC TIMESTAMP_NTZ and "now" is an explicit
# ``as_of``/``requested_at`` value, so hour-now and the cutoffs share one clock.


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a wall-clock UTC timestamp (no session zone involved)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(ts))


def ntz_literal(value) -> Column:
    """A wall-clock timestamp literal that no session or system time zone can shift."""
    if hasattr(value, "isoformat"):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def minus_seconds(ts: Column | str, seconds: int) -> Column:
    """``ts - seconds`` on a TIMESTAMP_NTZ column."""
    return F.timestamp_add("SECOND", F.lit(-int(seconds)), _c(ts))


def parse_int(s: Column | str) -> Column:
    """Strict integer parse of a text value; anything else is null.

    Only an optional sign and digits are accepted (no blanks, no decimals),
    and overflow is null rather than an error.
    """
    s = _c(s)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))


def round_half_up_float(p: Column | str) -> Column:
    """Go through a 32-bit float, then round half up (towards +inf) to an int."""
    return F.floor(_c(p).cast("float").cast("double") + F.lit(0.5)).cast("int")


def steps_to_target(target_hour: Column | str, now_hour: Column | str, step: int) -> Column:
    """Model applications needed to reach ``target_hour`` from ``now_hour``:
    one, and one more for each full ``step`` of the hours ahead.  An hour that has
    passed today is tomorrow's; hour 24 asked at midnight is a whole day ahead."""
    tomorrow = (_c(target_hour) < _c(now_hour)).cast("int")
    hours_ahead = _c(target_hour) - _c(now_hour) + F.lit(24) * tomorrow
    return (F.lit(1) + F.floor(hours_ahead / F.lit(step))).cast("int")


def horizon_guard(n: Column | str, max_steps: int) -> Column:
    """more steps than ``max_steps`` or n <= 1 mean a single application."""
    n = _c(n)
    return F.when((n > max_steps) | (n <= 1), F.lit(1)).otherwise(n)


def occupancy_decile(available_share: Column | str) -> Column:
    """Occupied share in tenths, ``round((1 - available) * 10)``."""
    return F.round((F.lit(1.0) - _c(available_share)) * 10).cast("int")


def iso_utc(ts: Column | str) -> Column:
    """C2 output form of a wall-clock UTC timestamp."""
    return F.date_format(_c(ts), ISO_UTC)


def property_attr(value: Column) -> Column:
    """One NGSI-LD property: ``{"value": v, "type": "Property"}``."""
    return F.struct(value.alias("value"), F.lit(PROPERTY_TYPE).alias("type"))

