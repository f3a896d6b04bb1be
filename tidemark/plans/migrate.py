"""Moving ageing rows from hot to cold: copy, resume, purge, marks, metrics, retention.

One job copies all tables at once: hot is scanned a single time, joined to the table
of windows and written straight to cold, without a shuffle. Every slice of a run is
its own partition of cold and is overwritten as a whole, so copying it again after a
lost driver changes nothing. Progress is recorded only after the write committed.

Which files of hot a run has seen is kept in a ledger (state ``hot_files``). A file that comes in behind the mark of
its table cannot be part of an earlier run's window; its rows before that mark are late, and are the only ones looked for:
a run without new files reads nothing behind the marks. Each late batch has its name from the run that first
saw its files, so copying it again after a crash replaces it.

With ``waves`` above one the tables are copied in that many jobs, each over its own
tables; what earlier waves recorded is not copied again when a later one fails.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.names import ripe_name, select_names
from tidemark.functions.times import ts_literal, whole_second
from tidemark.operators import metrics as run_reports
from tidemark.operators.retention import retention_limits
from tidemark.operators.windows import PURGE_MARGIN, plan_windows, purge_flags, migration_rows, slice_of
from tidemark.plans.store import COLD_PARTITIONS, HOT_PARTITIONS, TierStore
from tidemark.sources.files import (
    decoded_path, file_name, finish_rewrite, make_folder, overwrite_partitions, rewrite_keeping, settled, table_files,
)
from tidemark.sources.state import get_state, open_slices, put_state

# Up to this many names are put into a scan as literals; with more the scan is just less narrow.
MAX_LISTED_NAMES = 1000


# In the name of a late batch: cold may hold some of its rows already.
UNSURE = "unsure"

log = logging.getLogger("tidemark.migrate")


class MigrationError(RuntimeError):
    """Some tables could not be migrated; the others were."""


def utc_now() -> datetime:
    """Wall clock, for run durations only; windows take ``now`` as an argument."""
    return datetime.now(timezone.utc).replace(tzinfo=None)


def pending_windows(
    store: TierStore, now: datetime, migrate_after_days: int, patterns: Sequence[str] = ("*",), slices: int = 4
) -> DataFrame:
    """Windows of the selected, ripe tables, resumed where a run was cut short."""
    name = F.col("index")
    catalog = store.hot_names().where(
        select_names(name, patterns, hide_system=True) & ripe_name(name, now, migrate_after_days)
    )
    marks = store.marks()
    unfinished = open_slices(get_state(store.spark, store.root, "slice_state"), marks)
    return settled(plan_windows(catalog, marks, unfinished, now, migrate_after_days, slices), "windows")


def open_files(store: TierStore, hot: DataFrame, windows: DataFrame, patterns: Sequence[str], at: datetime) -> None:
    """Enter the files of ``hot`` that no run has seen into the ledger.

    Rows of such a file before ``late_before`` are not in any window it takes part in: that is the mark of its table, or
    the cutoff of a run that is being resumed, some of whose slices were done without the file. Tables that were migrated
    before there was a ledger have no entry yet: their files were part of any run, and may hold late rows or not.
    """
    index = F.regexp_replace("folder", "^index=", "")
    ledger = get_state(store.spark, store.root, "hot_files").select("file", "index")
    tables = ledger.select("index").distinct().withColumn("_kept", F.lit(True))
    new = table_files(hot).select("file", index.alias("index")).where(select_names(F.col("index"), patterns, hide_system=True))
    resumed = windows.where(F.size("pending") < F.col("slice_max")).select("index", F.col("cutoff").alias("_resumed"))
    marks = store.marks().select("index", F.col("migrated_before").alias("_mark"))
    late_before = F.coalesce(F.when(F.col("_kept"), F.col("_resumed")), F.col("_mark"))
    batch = F.concat(F.lit("late"), F.when(F.col("_kept"), F.lit("")).otherwise(F.lit(UNSURE)), F.lit(uuid.uuid4().hex))
    entries = (
        new.join(ledger.select("file"), "file", "left_anti").join(tables, "index", "left")
        .join(resumed, "index", "left").join(marks, "index", "left")
        .select(
            "file", "index", late_before.alias("late_before"), batch.alias("batch"),
            late_before.isNull().alias("done"), ts_literal(at).alias("updated_at"),
        )
    )
    put_state(entries, store.root, "hot_files")


def _known(files: DataFrame, at: datetime) -> DataFrame:
    """Ledger entries of files without late rows."""
    none = F.lit(None)
    return files.select(
        "file", "index", none.cast("timestamp_ntz").alias("late_before"), none.cast("string").alias("batch"),
        F.lit(True).alias("done"), ts_literal(at).alias("updated_at"),
    )


def rows_to_scan(store: TierStore, hot: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of ``hot`` that can lie in any of the windows.

    Restates what the windows have in common as literals, so that it reaches the files:
    nothing at or after the latest cutoff, nothing before the earliest mark but for
    tables that have none. Only a handful of values of the control table is looked at.
    """
    ts, limit = F.col(store.ts), MAX_LISTED_NAMES
    ends = windows.agg(F.min("window_from").alias("start"), F.max("cutoff").alias("end")).first()
    if ends["end"] is None:
        return hot.where(F.lit(False))
    rows = hot.where(ts < ts_literal(ends["end"]))
    resumed = windows.where(F.size("pending") < F.col("slice_max")).select("index", F.col("cutoff").alias("late_before"))
    if not resumed.isEmpty():  # files that came in while a run was half done: it is finished without them
        unseen = get_state(store.spark, store.root, "hot_files").where("NOT done")
        left_out = settled(unseen.join(resumed, ["index", "late_before"]).select("file"), "left-out")
        rows = rows.withColumn("file", file_name(F.col("_metadata.file_path"))).join(left_out, "file", "left_anti").drop("file")
    if ends["start"] is not None:
        unmarked = [r["index"] for r in windows.where("window_from IS NULL").select("index").limit(limit + 1).collect()]
        if len(unmarked) <= limit:
            rows = rows.where((ts >= ts_literal(ends["start"])) | F.col("index").isin(unmarked))
    return rows


def slice_rows(store: TierStore, hot: DataFrame, windows: DataFrame, slice_by: Column | None = None) -> DataFrame:
    """Rows to copy, with the cold partition they go to."""
    slice_number = slice_of(F.col(store.key), F.col("slice_max")) if slice_by is None else F.pmod(
        slice_by, F.col("slice_max")
    ).cast("int")
    return (
        migration_rows(rows_to_scan(store, hot, windows), windows, store.ts)
        .withColumn("slice", slice_number)
        .where(F.array_contains("pending", F.col("slice")))
        .withColumn("batch", batch_name(F.col("cutoff")))
        .select(*store.cold_schema.fieldNames())
    )


def batch_name(cutoff: Column) -> Column:
    return F.date_format(cutoff, "'w'yyyyMMddHHmmss")


def copied_counts(store: TierStore, windows: DataFrame) -> DataFrame:
    """Rows in cold per pending slice, zero included; counted from what was committed."""
    wanted = windows.select(
        "index", "cutoff", "slice_max", batch_name(F.col("cutoff")).alias("batch"), F.explode("pending").alias("slice")
    )
    batches = [r["batch"] for r in wanted.select("batch").distinct().limit(MAX_LISTED_NAMES + 1).collect()]
    held = store.cold()
    if len(batches) <= MAX_LISTED_NAMES:  # runs of this job, normally one: a partition filter
        held = held.where(F.col("batch").isin(batches))
    counts = held.groupBy("index", "batch", "slice").agg(F.count(F.lit(1)).alias("migrated"))
    return wanted.join(counts, ["index", "batch", "slice"], "left").withColumn(
        "migrated", F.coalesce("migrated", F.lit(0))
    )


def _slice_state(slices: DataFrame, done: bool, at: datetime) -> DataFrame:
    return slices.select(
        "index",
        F.col("cutoff").alias("cutoff_time"),
        "slice_max",
        F.col("slice").alias("slice_id"),
        "migrated",
        F.lit(done).alias("done"),
        ts_literal(at).alias("updated_at"),
    )


def migrate(
    store: TierStore,
    now: datetime,
    migrate_after_days: int,
    patterns: Sequence[str] = ("*",),
    slices: int = 4,
    waves: int = 1,
    delete_after: bool = False,
    late: bool = True,
    slice_by: Column | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    clock: Callable[[], datetime] = utc_now,
) -> int:
    """Run one migration over all selected tables; returns the rows copied.

    Order: open the run, copy, record slices, move the marks, write metrics; then rows of new files
    behind the marks are copied (unless ``late`` is false; a later run makes up for that), and hot is purged of what
    cold holds. All of it works on the files hot has when the run opens. Readers switch at the marks, so a purge only takes away what they no longer read.
    ``transform`` is applied to the rows on their way (unwrapping a document, say).
    A wave that fails is halved and tried again until the tables that make it fail stand alone, which takes jobs
    by the logarithm of its tables for each of them. Those keep their state, and the error is raised once all others are through.
    """
    store.prepare()
    windows = pending_windows(store, now, migrate_after_days, patterns, slices)
    hot = store.hot()
    open_files(store, hot, windows, patterns, clock())
    fresh = windows.select("index", "cutoff", "slice_max", F.explode("pending").alias("slice")).withColumn(
        "migrated", F.lit(None).cast("bigint")
    )
    put_state(_slice_state(fresh, False, clock()), store.root, "slice_state")

    copied, errors = 0, []
    wave = F.pmod(F.xxhash64("index"), F.lit(waves))
    waiting = [windows] if waves == 1 else [windows.where(wave == number) for number in range(waves)]
    while waiting:
        part, started = waiting.pop(0), clock()
        try:
            rows = _copy(store, hot, part, slice_by, transform, clock)
            put_state(
                part.select("index", F.col("cutoff").alias("migrated_before"), ts_literal(clock()).alias("updated_at")),
                store.root,
                "watermark",
            )
            record_runs(store, part, started, clock(), slices, None)
            copied += rows
        except Exception as error:  # a table that fails alone is recorded, the others still run
            parts = halves(part)
            waiting = [*parts, *waiting]
            if not parts:
                record_runs(store, part, started, clock(), slices, str(error).splitlines()[0])
                errors.append(error)
    chosen = select_names(F.col("index"), patterns, hide_system=True)
    try:
        if late:
            copy_late(store, chosen, slices, slice_by, transform, clock)
        if delete_after:
            purge(store, clock(), chosen)
    except Exception as error:  # made up for by any later run
        errors.append(error)
    if errors:
        raise MigrationError(f"{len(errors)} tables or steps of a run failed") from errors[0]
    return copied


def halves(windows: DataFrame) -> list[DataFrame]:
    """Two parts of some tables, by a bit in which hashes of their names differ; none where there is one table only."""
    name = F.xxhash64("index")
    seen = windows.agg(F.bit_or(name).alias("some"), F.bit_and(name).alias("all")).first()
    differing = ((seen["some"] or 0) ^ (seen["all"] or 0)) & (2**64 - 1)
    if not differing:
        return []
    bit = F.getbit(name, F.lit(differing.bit_length() - 1))
    return [windows.where(bit == value) for value in (0, 1)]


def _copy(store, hot, windows, slice_by, transform, clock) -> int:
    rows = slice_rows(store, hot, windows, slice_by)
    if transform is not None:
        rows = transform(rows).select(*store.cold_schema.fieldNames())
    progress, started = Observation(), clock()
    rows = rows.observe(progress, F.count(F.lit(1)).alias("rows"))
    overwrite_partitions(rows, store.cold_path, COLD_PARTITIONS, [F.col(store.ts)])
    put_state(_slice_state(copied_counts(store, windows), True, clock()), store.root, "slice_state")
    rows, seconds = progress.get["rows"], (clock() - started).total_seconds()
    log.info("copied %d rows in %.1f s, %.0f per second", rows, seconds, rows / seconds if seconds > 0 else 0.0)
    return rows


def purge(store: TierStore, at: datetime, chosen: Column | None = None) -> None:
    """Drop from hot the rows up to one hour before the mark that cold holds.

    Planned from the marks of copy and purge alone, so the hour left standing goes with a later
    run and a purge that failed is made up for. Only files whose late rows have been copied are looked at, and all that
    such a file has before the mark is in cold, so no row is compared with another.
    """
    purged = get_state(store.spark, store.root, "purge_mark").select("index", F.col("purged_before").alias("window_from"))
    marks = store.marks().select("index", F.col("migrated_before").alias("cutoff"))
    margin = F.expr(f"interval {int(PURGE_MARGIN.total_seconds())} seconds")
    windows = marks.join(purged, "index", "left").where(
        F.col("window_from").isNull() | (F.col("window_from") < F.col("cutoff") - margin)
    )
    if chosen is not None:
        windows = windows.where(chosen)
    windows = settled(windows.select("index", "window_from", "cutoff"), "purge")
    last = windows.agg(F.max("cutoff").alias("last")).first()["last"]
    if last is None:
        return
    # Rows that came in late lie before the last purge's mark: they go too, once they are copied.
    everything = windows.withColumn("window_from", F.lit(None).cast("timestamp_ntz"))
    copied = settled(get_state(store.spark, store.root, "hot_files").where("done").select(F.col("file").alias("_name")), "copied")

    def flags(rows: DataFrame) -> DataFrame:
        known = rows.withColumn("_name", file_name(F.col("_file"))).join(copied, "_name", "left_semi").drop("_name")
        return purge_flags(known, everything, store.ts).withColumn("_keep", F.coalesce(F.col("_keep"), F.lit(True)))

    def staged(files: DataFrame) -> None:
        """What is left of a file that was copied is copied too."""
        files = files.select("file", F.regexp_replace("folder", "^index=", "").alias("index"))
        put_state(_known(files, at), store.root, "hot_files")

    rewrite_keeping(store.spark, store.hot_path, store.hot_schema, HOT_PARTITIONS, flags, store.purge_staging, staged)
    put_state(
        windows.select("index", (F.col("cutoff") - margin).alias("purged_before"), ts_literal(at).alias("updated_at")),
        store.root,
        "purge_mark",
    )


def record_runs(
    store: TierStore, windows: DataFrame, started: datetime, completed: datetime, workers: int, error: str | None
) -> None:
    """One metric row per table of a run, counting the slices this run was to copy and did."""
    done = get_state(store.spark, store.root, "slice_state").where("done").drop("done", "updated_at")
    pending = windows.select(
        "index", F.col("cutoff").alias("cutoff_time"), "slice_max", F.explode("pending").alias("slice_id")
    )
    counts = (
        pending.join(done, ["index", "cutoff_time", "slice_max", "slice_id"])
        .groupBy("index", "cutoff_time")
        .agg(F.sum("migrated").alias("documents_migrated"))
    )
    runs = (
        windows.select("index", F.col("cutoff").alias("cutoff_time"))
        .join(counts, ["index", "cutoff_time"], "left")
    )
    runs = _timed(store, runs, started, completed, workers, error)
    put_state(run_reports.run_metrics(runs), store.root, "run_metrics")


def late_rows_of_new_files(store: TierStore, pending: DataFrame) -> DataFrame:
    """Rows of the pending files (file, late_before, batch) before ``late_before``; no other file is opened."""
    names = [r["file"] for r in pending.select("file").toLocalIterator()]
    paths = [decoded_path(store.spark, f"{store.hot_path}/", name) for name in names]
    rows = store.spark.read.schema(store.hot_schema).option("basePath", store.hot_path).parquet(*paths)
    named = rows.withColumn("file", file_name(F.col("_metadata.file_path")))
    return named.join(pending, "file").where(F.col(store.ts) < whole_second(F.col("late_before"))).drop("file", "late_before")


def copy_late(
    store: TierStore, chosen: Column, slices: int = 4, slice_by: Column | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None, clock: Callable[[], datetime] = utc_now,
) -> None:
    """Copy the late rows of files that the ledger has as not done, each batch of files under its own name.

    A file that is gone meanwhile needs nothing. Copied rows are recorded as runs of their tables.
    """
    started = clock()
    entries = get_state(store.spark, store.root, "hot_files").where(~F.col("done") & chosen)
    there = table_files(store.hot()).select("file")
    pending = settled(entries.join(there, "file", "left_semi").select("file", "index", "late_before", "batch"), "pending")
    if pending.isEmpty():
        return
    by = F.col(store.key) if slice_by is None else slice_by
    number = slice_of(by, slices) if slice_by is None else F.pmod(slice_by, F.lit(slices)).cast("int")
    rows = late_rows_of_new_files(store, pending.drop("index")).withColumn("slice", number)
    unsure = F.col("batch").startswith(f"late{UNSURE}")
    if not pending.where(unsure).isEmpty():  # once for a store from before the ledger
        held = store.cold().where(~unsure).select("index", F.col(store.key).alias("_key"), F.col(store.ts).alias("_ts"))
        same = F.col(store.key).eqNullSafe(F.col("_key")) & (F.col(store.ts) == F.col("_ts"))
        missing = rows.where(unsure).alias("r").join(
            held.alias("h"), (F.col("r.index") == F.col("h.index")) & same, "left_anti"
        )
        rows = rows.where(~unsure).unionByName(missing)
    if transform is not None:
        rows = transform(rows)
    overwrite_partitions(
        rows.select(*store.cold_schema.fieldNames()), store.cold_path, COLD_PARTITIONS, [F.col(store.ts)]
    )
    batches = pending.select("batch", "index").distinct()
    counts = store.cold().where(F.col("batch").startswith("late")).join(batches, ["batch", "index"], "left_semi")
    runs = counts.groupBy("index").agg(F.count(F.lit(1)).alias("documents_migrated")).join(
        pending.groupBy("index").agg(F.max("late_before").alias("cutoff_time")), "index"
    )
    put_state(run_reports.run_metrics(_timed(store, runs, started, clock(), slices, None), "-late"), store.root, "run_metrics")
    done = _known(pending.select("file", "index"), clock())
    put_state(done, store.root, "hot_files")


def _timed(store, runs, started, completed, workers, error) -> DataFrame:
    return runs.select(
        "index",
        ts_literal(started).alias("started_at"),
        ts_literal(completed).alias("completed_at"),
        F.coalesce("documents_migrated", F.lit(0)).alias("documents_migrated"),
        F.lit(workers).alias("workers"),
        F.lit(int(store.spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))).alias("batch_size"),
        F.lit(error).cast("string").alias("error"),
        "cutoff_time",
    )


def apply_retention(store: TierStore, now: datetime, rules: Mapping[str, int], default: int) -> None:
    """Delete cold rows past the age limit of their table, by the rules as they are now.

    The rules are matched with the names of cold's folders; rows are compared with the limit of their table.
    First looks only for the tables that hold older ones, with the youngest limit as a
    literal that skips files by their statistics; the rest is left alone.
    """
    finish_rewrite(store.spark, store.cold_path, store.retention_staging)
    make_folder(store.spark, store.cold_path)
    store.finish_packing()
    limits = settled(retention_limits(store.cold_names(), now, rules, default), "limits")
    youngest = limits.agg(F.max("kept_from").alias("youngest")).first()["youngest"]
    if youngest is None:
        return
    ts = F.col(store.ts)
    old = store.cold().where(ts < ts_literal(youngest)).join(limits, "index").where(ts < F.col("kept_from"))
    touched = settled(old.select("index", "kept_from").distinct(), "expired")
    rewrite_keeping(
        store.spark,
        store.cold_path,
        store.cold_schema,
        COLD_PARTITIONS,
        lambda rows: rows.join(touched, "index").withColumn("_keep", F.coalesce(ts >= F.col("kept_from"), F.lit(True))),
        store.retention_staging,
    )
