"""Aggregates over both tiers in which every row counts once.

They take the exact union, so a bucket that lies on the tier boundary gets the rows
of both sides. Spark reduces within each task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(rows: DataFrame, by: Sequence[str], *metrics: Column) -> DataFrame:
    """Rows per value, with further metrics."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("doc_count"), *metrics)


def date_histogram(rows: DataFrame, unit: str = "day", *metrics: Column, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Rows per time bucket."""
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket")
    return rows.groupBy(bucket, *by).agg(F.count(F.lit(1)).alias("doc_count"), *metrics)
