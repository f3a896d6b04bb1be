"""Cold retention: rows past the age limit of their table go."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import cold_days
from tidemark.functions.times import ts_literal


def is_kept(index: Column, ts: Column, now: datetime, rules: Mapping[str, int], default: int) -> Column:
    """Row is young enough for its table; zero days keeps for ever."""
    days = cold_days(index, rules, default)
    return (days <= 0) | (ts >= F.timestamp_add("DAY", -days, ts_literal(now)))


def retention_limits(names: DataFrame, now: datetime, rules: Mapping[str, int], default: int) -> DataFrame:
    """(index, kept_from) of the tables that have an age limit: the rules are matched once per table, not per row."""
    days = cold_days(F.col("index"), rules, default)
    limits = names.where(F.col("index").isNotNull()).select("index", days.alias("_days")).where("_days > 0")
    return limits.select("index", F.timestamp_add("DAY", -F.col("_days"), ts_literal(now)).alias("kept_from"))


def retained(rows: DataFrame, now: datetime, rules: Mapping[str, int], default: int, ts: str = "ts") -> DataFrame:
    return rows.where(is_kept(F.col("index"), F.col(ts), now, rules, default))
