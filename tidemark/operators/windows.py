"""Incremental windows per table, slices, and what a resumed run still has to do.

Windows are a control table with one row per index
``(index, window_from, cutoff, ...)``. It is joined to the rows on ``index``: Spark
broadcasts it while it is small, and prunes the partitions of tables without a window.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import ts_literal, whole_second

PURGE_MARGIN = timedelta(hours=1)


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """``start <= ts < end`` on whole seconds; no start means from the beginning.

    Both ends are cut to seconds, so the windows of successive runs join without gap.
    """
    return (ts < whole_second(end)) & (start.isNull() | (ts >= whole_second(start)))


def in_purge_window(ts: Column, start: Column, end: Column) -> Column:
    """The same window ending one hour earlier, for rows that may still arrive around the cutoff."""
    margin = F.expr(f"interval {int(PURGE_MARGIN.total_seconds())} seconds")
    return in_window(ts, start, end - margin)


def plan_windows(
    catalog: DataFrame, marks: DataFrame, open_slices: DataFrame, now: datetime, migrate_after_days: int, slices: int
) -> DataFrame:
    """One row per table: ``(index, window_from, cutoff, slice_max, pending)``.

    A run starts at the mark and ends at ``now - migrate_after_days``. A table with an
    unfinished run keeps the cutoff and slice count of that run and has only the
    slices left that are not done. Tables with nothing left are dropped.
    """
    fresh = F.lit(None).cast("array<int>")
    unfinished = open_slices.groupBy("index").agg(
        F.min(F.struct("cutoff_time", "slice_max")).alias("_run"),
        F.collect_set(F.when(~F.col("done"), F.struct("cutoff_time", "slice_max", "slice_id"))).alias("_left"),
    )
    left = F.transform(
        F.filter("_left", lambda s: (s["cutoff_time"] == F.col("_run.cutoff_time")) & (s["slice_max"] == F.col("_run.slice_max"))),
        lambda s: s["slice_id"],
    )
    new_cutoff = whole_second(ts_literal(now - timedelta(days=migrate_after_days)))
    return (
        catalog.select("index")
        .join(marks.select("index", "migrated_before"), "index", "left")
        .join(unfinished, "index", "left")
        .select(
            "index",
            F.col("migrated_before").alias("window_from"),
            F.coalesce(F.col("_run.cutoff_time"), new_cutoff).alias("cutoff"),
            F.coalesce(F.col("_run.slice_max"), F.lit(slices)).alias("slice_max"),
            F.when(F.col("_run").isNull(), fresh).otherwise(left).alias("_left"),
        )
        .withColumn("pending", F.coalesce("_left", F.sequence(F.lit(0), F.col("slice_max") - 1)))
        .drop("_left")
        .where(F.col("window_from").isNull() | (F.col("cutoff") > F.col("window_from")))
    )


def migration_rows(rows: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows inside the window of their table, with the window's columns."""
    return rows.join(windows, "index").where(in_window(F.col(ts), F.col("window_from"), F.col("cutoff")))


def purge_flags(rows: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of tables with a window, ``_keep`` false for those a purge removes."""
    purge = in_purge_window(F.col(ts), F.col("window_from"), F.col("cutoff"))
    return rows.join(windows.select("index", "window_from", "cutoff"), "index").withColumn("_keep", ~purge).drop(
        "window_from", "cutoff"
    )


def slice_of(key: Column, slices: Column | int) -> Column:
    """Slice of a row by a hash of its key."""
    count = F.lit(slices) if isinstance(slices, int) else slices
    return F.pmod(F.xxhash64(key), count).cast("int")


def sliced(rows: DataFrame, slices: int, key: Column, hashed: bool = True) -> DataFrame:
    """Rows with the slice they are exported in; ``hashed=False`` takes the key itself as the number."""
    number = slice_of(key, slices) if hashed else F.pmod(key, F.lit(slices)).cast("int")
    return rows.withColumn("slice", number if slices > 1 else F.lit(0))


def slices_to_do(windows: DataFrame, done: DataFrame) -> DataFrame:
    """``(index, cutoff, slice_max, slice)`` still to copy: all slices but those recorded as done."""
    every = windows.select(
        "index", "cutoff", "slice_max", F.explode(F.sequence(F.lit(0), F.col("slice_max") - 1)).alias("slice")
    )
    finished = done.where("done").select(
        "index", F.col("cutoff_time").alias("cutoff"), "slice_max", F.col("slice_id").alias("slice")
    )
    return every.join(finished, ["index", "cutoff", "slice_max", "slice"], "left_anti")


def advanced_marks(marks: DataFrame, windows: DataFrame, now: datetime) -> DataFrame:
    """High-water marks after the windows were copied in full: the mark moves to the cutoff."""
    moved = windows.select(
        "index", F.col("cutoff").alias("migrated_before"), ts_literal(now).alias("updated_at")
    )
    return moved if marks is None else marks.select(*moved.columns).unionByName(moved)
