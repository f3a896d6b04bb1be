"""Time literals and date math as column expressions.

Every result is TIMESTAMP_NTZ holding UTC wall time, and ``now`` is always an
argument, so a job gives the same answer whenever and wherever it is run.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of a time literal.
NOW_PATTERN = r"^now(?:([+-])([0-9]+)([smhdwMy]))?(?:\|\|[^\n]*)?\z"
STAMP_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(?:T[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?\z"
)

# Seconds per clock unit.
CLOCK_UNITS = {"s": 1, "m": 60, "h": 3600}

# A signed 64-bit count of nanoseconds holds this many seconds; clock steps saturate there.
MAX_CLOCK_SECONDS = 9_223_372_036
# Calendar steps saturate so that the result stays between the years 1 and 9999.
MAX_CALENDAR_DAYS = 700_000
MAX_CALENDAR_MONTHS = 22_800
MIN_EPOCH_MILLIS = -62_135_596_800_000
MAX_EPOCH_MILLIS = 253_402_300_799_999


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it several times within one expression."""
    return F.get(F.transform(F.array(value), use), 0)


def ts_literal(value: datetime | str | Column) -> Column:
    """A timestamp constant without zone."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def whole_second(ts: Column) -> Column:
    """Cut a timestamp to whole seconds."""
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def at_micros(micros: Column) -> Column:
    """Timestamp at a number of microseconds since the epoch."""
    return F.timestamp_add("MICROSECOND", micros, ts_literal("1970-01-01 00:00:00"))


def micros_of(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.timestamp_diff("MICROSECOND", ts_literal("1970-01-01 00:00:00"), ts)


def epoch_millis(number: Column) -> Column:
    """Timestamp of an epoch-millisecond number; a fraction is cut."""
    bounded = F.least(F.greatest(number, F.lit(float(MIN_EPOCH_MILLIS))), F.lit(float(MAX_EPOCH_MILLIS)))
    return F.when(number.isNotNull(), at_micros(bounded.cast("bigint") * 1000))


def add_days(ts: Column, days: Column | int) -> Column:
    """Calendar days later (earlier when negative)."""
    return F.timestamp_add("DAY", F.lit(days) if isinstance(days, int) else days, ts)


def add_months_overflowing(ts: Column, months: Column) -> Column:
    """Month step where a day past the end of the month runs into the next one.

    March 31 minus one month is March 2 in a leap year. ``add_months`` alone
    would clamp to February 29, so step from the first of the month and add the
    day of the month back.
    """
    day = ts.cast("date")
    first = F.add_months(F.trunc(day, "MM"), months.cast("int"))
    moved = F.date_add(first, F.dayofmonth(day) - 1).cast("timestamp_ntz")
    since_midnight = F.timestamp_diff("MICROSECOND", day.cast("timestamp_ntz"), ts)
    return F.timestamp_add("MICROSECOND", since_midnight, moved)


def _bounded(count: Column, limit: int) -> Column:
    return F.least(count, F.lit(limit).cast("bigint"))


def date_math(text: Column, now: Column) -> Column:
    """``now``, ``now-7d``, ``now+2M||/d`` -> timestamp; anything else is null.

    One step only; text after ``||`` is ignored. A count that does not fit 64
    bits is null, a smaller but extreme one saturates.
    """
    step = F.struct(
        F.regexp_extract(text, NOW_PATTERN, 1).alias("sign"),
        F.regexp_extract(text, NOW_PATTERN, 2).try_cast("bigint").alias("count"),
        F.regexp_extract(text, NOW_PATTERN, 3).alias("unit"),
    )

    def moved(step: Column) -> Column:
        count, unit = step["count"], step["unit"]
        sign = F.when(step["sign"] == "-", F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        result = F.when(step["sign"] == "", now).when(count.isNull(), F.lit(None).cast("timestamp_ntz"))
        for name, seconds in CLOCK_UNITS.items():
            amount = _bounded(count, MAX_CLOCK_SECONDS // seconds) * seconds
            result = result.when(unit == name, F.timestamp_add("SECOND", sign * amount, now))
        months, years = _bounded(count, MAX_CALENDAR_MONTHS), _bounded(count, MAX_CALENDAR_MONTHS // 12) * 12
        return (
            result.when(unit == "d", add_days(now, sign * _bounded(count, MAX_CALENDAR_DAYS)))
            .when(unit == "w", add_days(now, sign * _bounded(count, MAX_CALENDAR_DAYS // 7) * 7))
            .when(unit == "M", add_months_overflowing(now, sign * months))
            .when(unit == "y", add_months_overflowing(now, sign * years))
        )

    return F.when(text.startswith("now") & F.rlike(text, F.lit(NOW_PATTERN)), bind(step, moved))


def stamp(text: Column) -> Column:
    """RFC 3339, ``yyyy-MM-ddTHH:mm:ss`` or ``yyyy-MM-dd`` text -> timestamp, else null.

    The pattern decides what is a time at all; the cast then reads it and refuses days
    and hours that do not exist.
    """
    zoned = text.endswith("Z") | F.substring(text, -6, 1).isin("+", "-")
    full = (
        F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z")))
        .when(zoned, text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    instant = F.translate(full, ",", ".").try_cast("timestamp")
    return F.when(F.rlike(text, F.lit(STAMP_PATTERN)), at_micros(F.unix_micros(instant)))


def time_text(text: Column, now: Column) -> Column:
    """Time given as text: date math first, then a stamp."""
    return F.coalesce(date_math(text, now), stamp(text))


def time_value(value: Column, now: Column) -> Column:
    """Time given as a JSON value (VARIANT): text, or a number of epoch milliseconds."""

    def read(kind: Column) -> Column:
        is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        text = bind(F.try_variant_get(value, "$", "string"), lambda t: time_text(t, now))
        return F.when(kind == "STRING", text).when(
            is_number, epoch_millis(F.try_variant_get(value, "$", "double"))
        )

    return F.when(value.isNotNull(), bind(F.schema_of_variant(value), read))
