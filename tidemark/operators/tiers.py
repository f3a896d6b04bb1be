"""Scans of one tier and unions of both."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import is_system_name, select_names
from tidemark.functions.times import ts_literal
from tidemark.sources.files import settled


def scan(
    rows: DataFrame,
    indices: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    ts: str = "ts",
    hide_system: bool = False,
) -> DataFrame:
    """Rows of the named tables with ``start <= ts < end``.

    Names filter the ``index`` partition column, bounds are literals and reach the files.
    """
    if indices is not None:
        rows = rows.where(select_names(F.col("index"), indices, hide_system))
    if start is not None:
        rows = rows.where(F.col(ts) >= ts_literal(start))
    if end is not None:
        rows = rows.where(F.col(ts) < ts_literal(end))
    return rows


def hot_scan(rows: DataFrame, now: datetime, retention_days: int, ts: str = "ts") -> DataFrame:
    """Rows young enough for the hot tier."""
    return scan(rows, start=now - timedelta(days=retention_days), ts=ts)


def cold_scan(rows: DataFrame, now: datetime, retention_days: int, ts: str = "ts") -> DataFrame:
    """Rows old enough for the cold tier."""
    return scan(rows, end=now - timedelta(days=retention_days), ts=ts)


def index_catalog(rows: DataFrame, hot: bool = True) -> DataFrame:
    """Names of the tables that hold rows; in the hot tier without the store's own."""
    names = rows.select("index").where(F.col("index") != "")
    if hot:
        names = names.where(~is_system_name(F.col("index")))
    return names.distinct().orderBy("index")


def union_all(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot rows and cold rows as a bag: a row held by both tiers comes twice."""
    return hot.withColumn("tier", F.lit("hot")).unionByName(
        cold.withColumn("tier", F.lit("cold")), allowMissingColumns=True
    )


def union_exact(
    hot: DataFrame,
    cold: DataFrame,
    boundary: datetime | DataFrame,
    ts: str = "ts",
    include_late: bool = False,
    key: str = "event_id",
) -> DataFrame:
    """Both tiers as one table in which every row comes once.

    ``boundary`` is one moment, or a table ``(index, migrated_before)``: up to its
    high-water mark a table is read from cold, from there on from hot; a table
    without a mark is read from hot. No row is compared with another one.

    ``include_late`` also shows hot rows older than the mark that were never copied,
    by an anti join of just those rows on ``(index, key)``.
    """
    if isinstance(boundary, datetime):
        recent = hot.where(F.col(ts) >= ts_literal(boundary))
        behind = hot.where(F.col(ts) < ts_literal(boundary))
        old = cold.where(F.col(ts) < ts_literal(boundary))
    else:
        marks = boundary.select("index", F.col("migrated_before").alias("_mark"))
        mark = F.col("_mark")
        marked_hot = hot.join(marks, "index", "left")
        recent = marked_hot.where(mark.isNull() | (F.col(ts) >= mark)).drop("_mark")
        behind = marked_hot.where(F.col(ts) < mark).drop("_mark")
        old = cold.join(marks, "index").where(F.col(ts) < mark).drop("_mark")
    both = union_all(recent, old)
    if include_late:
        late = behind.join(_held_near(old, behind, ts).select("index", key), ["index", key], "left_anti")
        both = both.unionByName(late.withColumn("tier", F.lit("hot")), allowMissingColumns=True)
    return both


def _held_near(cold: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    """Cold rows within the time span that ``rows`` have in their table; none elsewhere can equal one of them."""
    spans = rows.groupBy("index").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    near = F.col(ts).between(F.col("_first"), F.col("_last"))
    return cold.join(settled(spans, "spans"), "index").where(near).drop("_first", "_last")


def late_rows(hot: DataFrame, cold: DataFrame, marks: DataFrame, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Hot rows older than the mark of their table that cold does not hold."""
    mark = marks.select("index", F.col("migrated_before").alias("_mark"))
    behind = hot.join(mark, "index").where(F.col(ts) < F.col("_mark"))
    copied = _held_near(cold, behind, ts).select("index", key)
    return behind.join(copied, ["index", key], "left_anti").drop("_mark")


def lifecycle_stage(age_of: Column, now: datetime, migrate_days: int, retention_days: int, cold_days: int) -> Column:
    """Stage of a row by age: hot only, copied but still in hot, cold only, gone."""

    def before(days: int) -> Column:
        return age_of < ts_literal(now - timedelta(days=days))

    gone = before(cold_days) if cold_days > 0 else F.lit(False)
    return (
        F.when(gone, F.lit("expired"))
        .when(before(retention_days), F.lit("cold"))
        .when(before(migrate_days), F.lit("both"))
        .otherwise(F.lit("hot"))
    )


def with_lifecycle_stage(
    rows: DataFrame, now: datetime, migrate_days: int, retention_days: int, cold_days: int, ts: str = "ts"
) -> DataFrame:
    stage = lifecycle_stage(F.col(ts), now, migrate_days, retention_days, cold_days)
    return rows.withColumn("stage", stage)
