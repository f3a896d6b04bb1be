"""Migration windows, slices, marks, purge, retention, and whole runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.names import index_date
from tidemark.functions.times import ts_literal
from tidemark.operators import indices, retention, tiers, windows
from tidemark.plans.migrate import MigrationError, apply_retention, migrate
from tidemark.plans.packing import fold_states, pack_cold
from tidemark.plans.search import tiered_rows
from tidemark.plans.store import TierStore
from tidemark.queries import data
from tidemark.queries.data import BEHIND_MARK_SQL, EVENTS_SQL, NOW
from tidemark.sources.files import new_folder, read_table, remove, settled
from tidemark.sources.state import get_state, open_slices, upsert
from tidemark.streaming.copy import start_copy

COLD_RULES = {"events-2024.01.05": 0, "events-2024.01.0*": 24, "events-2024.01.2*": 9}


def _windows(rows: DataFrame) -> DataFrame:
    """A window per daily table: every third day has no mark yet, the others one two days back."""
    day = index_date(F.col("index"))
    start = F.when(F.dayofmonth(day) % 3 != 0, ts_literal("2024-01-22 06:30:15.75"))
    return settled(
        indices.index_catalog_of(rows).select(
            "index",
            start.alias("window_from"),
            ts_literal("2024-01-23 18:45:30.25").alias("cutoff"),
            F.lit(data.SLICES).alias("slice_max"),
        ),
        "windows",
    )


def migration_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.events(spark, sf_dir)
    return windows.migration_rows(rows, _windows(rows)).select("event_id", "index", "ts")


def purge_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.events(spark, sf_dir)
    flagged = windows.purge_flags(rows, _windows(rows))
    return flagged.groupBy("index").agg(
        F.count_if(F.col("_keep")).alias("kept"), F.count_if(~F.col("_keep")).alias("purged")
    )


def sliced_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.cold_scan_rows(spark, sf_dir)
    parts = windows.sliced(rows, data.SLICES, F.col("user_id"), hashed=False)
    return parts.groupBy("index", "slice").agg(
        F.count(F.lit(1)).alias("docs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def _done(planned: DataFrame) -> DataFrame:
    """Progress of a broken run: the slices up to the last digit of the day are done."""
    every = planned.withColumn("slice_id", F.explode(F.sequence(F.lit(0), F.col("slice_max") - 1)))
    return every.select(
        "index",
        F.col("cutoff").alias("cutoff_time"),
        "slice_max",
        "slice_id",
        F.lit(1).cast("bigint").alias("migrated"),
        (F.col("slice_id") < F.dayofmonth(index_date(F.col("index"))) % 10).alias("done"),
        ts_literal(NOW).alias("updated_at"),
    )


def resume_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _windows(data.events(spark, sf_dir))
    return windows.slices_to_do(planned, _done(planned)).select("index", "cutoff", "slice")


def resume_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the next run: unfinished runs keep their cutoff and what is left of their slices."""
    rows = data.events(spark, sf_dir)
    planned = _windows(rows)
    marks = planned.where("window_from IS NOT NULL").select("index", F.col("window_from").alias("migrated_before"))
    broken = _done(planned).where(index_date(F.col("index")) < "2024-01-20")
    resumed = windows.plan_windows(
        indices.ripe(data.catalog(rows), NOW, data.MIGRATE_DAYS),
        marks,
        open_slices(broken, marks),
        NOW,
        data.MIGRATE_DAYS,
        2,
    )
    return resumed.select(
        "index",
        "window_from",
        "cutoff",
        F.array_join(F.transform(F.sort_array("pending"), lambda s: s.cast("string")), ",").alias("pending"),
    )


def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _windows(data.events(spark, sf_dir))
    old = planned.where("window_from IS NOT NULL").select(
        "index", F.col("window_from").alias("migrated_before"), F.col("window_from").alias("updated_at")
    )
    moved = planned.where(windows_done(F.col("index")))
    return upsert(old, windows.advanced_marks(None, moved, NOW), ["index"], "updated_at")


def windows_done(index):
    """Tables whose run went through."""
    return F.dayofmonth(index_date(index)) < 20


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's state is their last event; the newer half is put over the older one."""
    rows = data.events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    old, new = rows.where(F.col("ts") < "2024-01-15"), rows.where(F.col("ts") >= "2024-01-15")
    return upsert(old, new, ["user_id"], "ts")


def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark and unfinished slices of every table, null where it has none."""
    planned = _windows(data.events(spark, sf_dir))
    marks = planned.where("window_from IS NOT NULL").select("index", F.col("window_from").alias("migrated_before"))
    finished = F.dayofmonth(index_date(F.col("index"))) > 25
    state = _done(planned).withColumn(
        "cutoff_time", F.when(finished, ts_literal("2024-01-20 00:00:00")).otherwise(F.col("cutoff_time"))
    )
    unfinished = open_slices(state, marks).groupBy("index").agg(F.count_if(~F.col("done")).alias("open"))
    return planned.select("index").join(marks, "index", "left").join(unfinished, "index", "left")


def cold_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.events(spark, sf_dir)
    return retention.retained(rows, NOW, COLD_RULES, data.COLD_DAYS).select("event_id", "index")


def lifecycle_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = tiers.with_lifecycle_stage(
        data.events(spark, sf_dir), NOW, data.MIGRATE_DAYS, data.RETENTION_DAYS, data.COLD_DAYS
    )
    return staged.groupBy("stage").agg(F.count(F.lit(1)).alias("docs"), F.min("ts").alias("first_ts"))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, cold, marks = data.both_tiers(data.events(spark, sf_dir))
    return tiers.late_rows(hot, cold.where("event_type <> 'error'"), marks).select("event_id", "index", "ts")


def _store(spark: SparkSession, rows: DataFrame) -> TierStore:
    kept = StructType([f for f in rows.schema.fields if f.name != "index"])
    store = TierStore(spark, new_folder(spark, "store"), kept)
    store.append_hot(rows)
    return store


def _typed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One undated table per event type, so that every run finds rows in every table."""
    rows = data.events(spark, sf_dir).select("event_id", "ts", "user_id", "value", "event_type")
    return rows.withColumnRenamed("event_type", "index")


def _migrated(spark: SparkSession, sf_dir: str, **options: object) -> TierStore:
    """Two runs a week apart."""
    store = _store(spark, _typed_tables(spark, sf_dir))
    for now in (NOW - timedelta(days=7), NOW):
        migrate(store, now, data.MIGRATE_DAYS, slices=data.SLICES, slice_by=F.col("user_id"), **options)
    return store


def migrate_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _migrated(spark, sf_dir).cold().groupBy("index", "batch", "slice").agg(
        F.count(F.lit(1)).alias("docs"), F.max("value").alias("max_value"), F.max("ts").alias("last_ts")
    )


def cold_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold after two runs, a packing, a third run and another packing; small files are few, rows and order of time are kept."""
    store = _migrated(spark, sf_dir)
    pack_cold(store)
    fold_states(store)
    migrate(store, NOW + timedelta(days=1), data.MIGRATE_DAYS, slices=data.SLICES, slice_by=F.col("user_id"))
    pack_cold(store)
    fold_states(store)
    files = F.col("_metadata.file_path")
    rows = read_table(spark, store.cold_path, store.cold_schema).withColumn("_file", files)
    marks = store.marks().select("index", "migrated_before")
    return rows.groupBy("index").agg(
        F.count(F.lit(1)).alias("docs"), F.count_distinct("_file").alias("files"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.sum("event_id").alias("ids"),
    ).join(marks, "index")


def migrate_and_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tiers after runs that purge, read as one table: nothing lost, nothing twice."""
    return _shown_after_purge(_migrated(spark, sf_dir, delete_after=True, waves=2))


def _shown_after_purge(store: TierStore) -> DataFrame:
    hot_left = store.hot().groupBy("index").agg(F.count(F.lit(1)).alias("in_hot"))
    shown = tiers.union_exact(store.hot(), store.cold(), store.marks())
    counts = shown.groupBy("index").agg(
        F.count_if(F.col("tier") == "hot").alias("from_hot"), F.count_if(F.col("tier") == "cold").alias("from_cold")
    )
    return counts.join(hot_left, "index", "left")


def migrate_with_bad_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tables stand after two runs, in the first of which one table cannot be read."""

    def unreadable(rows: DataFrame) -> DataFrame:
        return rows.withColumn("ts", F.when(F.col("index") == "view", F.raise_error(F.lit("cannot be read"))).otherwise(F.col("ts")))

    store = _store(spark, _typed_tables(spark, sf_dir))
    try:
        migrate(store, NOW - timedelta(days=7), data.MIGRATE_DAYS, transform=unreadable)
    except MigrationError:
        migrate(store, NOW, data.MIGRATE_DAYS)
    runs = get_state(spark, store.root, "run_metrics").groupBy("index").agg(
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("succeeded")
    )
    held = store.cold().groupBy("index").agg(F.count(F.lit(1)).alias("docs"), F.max("ts").alias("last_ts"))
    return store.marks().select("index", "migrated_before").join(runs, "index").join(held, "index", "left")


def retention_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold after a retention run that deletes whole tables and parts of others."""
    store = _migrated(spark, sf_dir)
    apply_retention(store, NOW, {"error": 0, "v*": 12}, data.COLD_DAYS)
    return store.cold().groupBy("index").agg(F.count(F.lit(1)).alias("docs"), F.min("ts").alias("first_ts"))


def _is_late():
    return (F.col("ts") < "2024-01-10") & (F.col("value") < 10)


def late_by_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold after three runs, rows behind the marks coming in before the second; some rows have no key."""
    rows = _typed_tables(spark, sf_dir).withColumn("event_id", F.when(F.col("value") >= 5, F.col("event_id")))
    store = _store(spark, rows.where(~_is_late()))
    for now in (NOW - timedelta(days=7), NOW, NOW + timedelta(hours=1)):
        migrate(store, now, data.MIGRATE_DAYS, slices=data.SLICES, slice_by=F.col("user_id"))
        if now < NOW:
            store.append_hot(rows.where(_is_late()))
    late = F.col("batch").startswith("late").alias("late")
    return store.cold().groupBy("index", late).agg(F.count(F.lit(1)).alias("docs"), F.count("event_id").alias("keyed"))


def migrate_late_then_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows that came in after a purge, copied and purged by the next run."""
    rows = _typed_tables(spark, sf_dir)
    store = _store(spark, rows.where(~_is_late()))
    for now in (NOW - timedelta(days=7), NOW):
        migrate(store, now, data.MIGRATE_DAYS, slices=data.SLICES, delete_after=True)
        if now < NOW:
            store.append_hot(rows.where(_is_late()))
    migrate(store, NOW, data.MIGRATE_DAYS, slices=data.SLICES, delete_after=True)
    return _shown_after_purge(store)


def migrate_stopped_after_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose driver was lost after the purge, before its mark was written, and the one that followed."""
    store = _migrated(spark, sf_dir, delete_after=True)
    remove(spark, f"{store.root}/state/purge_mark")
    migrate(store, NOW, data.MIGRATE_DAYS, slices=data.SLICES, delete_after=True)
    return _shown_after_purge(store)


RANGES = {
    "old": (datetime(2024, 1, 10, 6), datetime(2024, 1, 12)),
    "recent": (datetime(2024, 1, 25), datetime(2024, 1, 26, 18)),
    "across": (datetime(2024, 1, 23, 12), datetime(2024, 1, 24, 12)),
}


def search_pruned_by_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three ranges of a migrated store; the first two are read from one tier only."""
    store = _migrated(spark, sf_dir)
    found = [
        tiered_rows(store.hot(), store.cold(), store.marks(), a, b, ["*r*"], tables=store.hot_names())
        .select(F.lit(name).alias("range"), "event_id", "index", "tier")
        for name, (a, b) in RANGES.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def streaming_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals into hot, each followed by a trigger; the second brings late rows."""
    rows = _typed_tables(spark, sf_dir)
    late = (F.col("ts") < "2024-01-10") & (F.col("value") < 10)
    store = _store(spark, rows.where(~late))
    checkpoint = new_folder(spark, "stream")
    options = {"slices": data.SLICES, "slice_by": F.col("user_id")}
    for now in (NOW - timedelta(days=7), NOW):
        start_copy(store, checkpoint, lambda now=now: now, data.MIGRATE_DAYS, **options).awaitTermination()
        if now != NOW:
            store.append_hot(rows.where(late))
    return store.cold().select("event_id", "index", "ts", F.col("batch").startswith("late").alias("late"))


QUERIES = {
    "migration_window": migration_window,
    "purge_window": purge_window,
    "sliced_export": sliced_export,
    "resume_slices": resume_slices,
    "resume_windows": resume_windows,
    "watermark_advance": watermark_advance,
    "keyed_upsert": keyed_upsert,
    "state_lookup": state_lookup,
    "cold_retention": cold_retention,
    "lifecycle_stage": lifecycle_stage,
    "late_rows": late_rows,
    "migrate_incremental": migrate_incremental,
    "migrate_and_purge": migrate_and_purge,
    "migrate_with_bad_table": migrate_with_bad_table,
    "cold_compacted": cold_compacted,
    "retention_run": retention_run,
    "streaming_copy": streaming_copy,
    "late_by_ledger": late_by_ledger,
    "migrate_late_then_purge": migrate_late_then_purge,
    "migrate_stopped_after_purge": migrate_stopped_after_purge,
    "search_pruned_by_marks": search_pruned_by_marks,
}

_WINDOW_SQL = f"""(SELECT *, CASE WHEN day(ts) % 3 <> 0 THEN TIMESTAMP '2024-01-22 06:30:15.75' END AS window_from,
  TIMESTAMP '2024-01-23 18:45:30.25' AS cutoff FROM {EVENTS_SQL})"""
_TABLES_SQL = f"""(SELECT DISTINCT "index", window_from, cutoff, day(ts) AS d FROM {_WINDOW_SQL})"""
_START_SQL = "(window_from IS NULL OR ts >= TIMESTAMP '2024-01-22 06:30:15')"
_CUTOFFS = "ts < TIMESTAMP '2024-01-24'"

ORACLES = {
    "migration_window": f"""SELECT event_id, "index", ts FROM {_WINDOW_SQL}
      WHERE {_START_SQL} AND ts < TIMESTAMP '2024-01-23 18:45:30'""",
    "purge_window": f"""SELECT "index", count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS purged
      FROM (SELECT *, {_START_SQL} AND ts < TIMESTAMP '2024-01-23 17:45:30' AS gone FROM {_WINDOW_SQL}) GROUP BY 1""",
    "sliced_export": f"""SELECT "index", CAST(user_id % 4 AS INTEGER) AS slice, count(*) AS docs, min(ts) AS first_ts,
      max(ts) AS last_ts FROM {EVENTS_SQL} WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2""",
    "resume_slices": f"""SELECT "index", cutoff, CAST(slice AS INTEGER) AS slice
      FROM {_TABLES_SQL}, range(4) slices(slice) WHERE slice >= d % 10""",
    "resume_windows": f"""SELECT "index", window_from,
        CASE WHEN d < 20 THEN cutoff ELSE TIMESTAMP '2024-01-24' END AS cutoff,
        CASE WHEN d < 20 THEN CASE d % 10 WHEN 0 THEN '0,1,2,3' WHEN 1 THEN '1,2,3' WHEN 2 THEN '2,3' WHEN 3 THEN '3' ELSE '' END
          ELSE '0,1' END AS pending
      FROM {_TABLES_SQL} WHERE d < 24""",
    "watermark_advance": f"""SELECT "index", CASE WHEN d < 20 THEN cutoff ELSE window_from END AS migrated_before,
      CASE WHEN d < 20 THEN TIMESTAMP '2024-01-31' ELSE window_from END AS updated_at
      FROM {_TABLES_SQL} WHERE d < 20 OR window_from IS NOT NULL""",
    "keyed_upsert": """SELECT user_id, ts, event_id, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "state_lookup": f"""SELECT "index", window_from AS migrated_before,
        CASE WHEN d <= 25 OR window_from IS NULL THEN 4 - least(d % 10, 4) END AS open FROM {_TABLES_SQL}""",
    "cold_retention": f"""SELECT event_id, "index" FROM {EVENTS_SQL} WHERE CASE WHEN day(ts) = 5 THEN true
      WHEN day(ts) < 10 THEN ts >= TIMESTAMP '2024-01-07' WHEN day(ts) BETWEEN 20 AND 29 THEN ts >= TIMESTAMP '2024-01-22'
      ELSE ts >= TIMESTAMP '2024-01-11' END""",
    "lifecycle_stage": """SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'expired' WHEN ts < TIMESTAMP '2024-01-21' THEN 'cold'
      WHEN ts < TIMESTAMP '2024-01-24' THEN 'both' ELSE 'hot' END AS stage, count(*) AS docs, min(ts) AS first_ts
      FROM events GROUP BY 1""",
    "late_rows": f"""SELECT event_id, "index", ts FROM {EVENTS_SQL} WHERE event_type = 'error' AND {BEHIND_MARK_SQL}""",
    "migrate_incremental": f"""SELECT event_type AS "index",
      CASE WHEN ts < TIMESTAMP '2024-01-17' THEN 'w20240117000000' ELSE 'w20240124000000' END AS batch,
      CAST(user_id % 4 AS INTEGER) AS slice, count(*) AS docs, max(value) AS max_value, max(ts) AS last_ts
      FROM events WHERE {_CUTOFFS} GROUP BY ALL""",
    "migrate_and_purge": f"""SELECT event_type AS "index", count(*) FILTER (NOT {_CUTOFFS}) AS from_hot,
      count(*) FILTER ({_CUTOFFS}) AS from_cold, count(*) FILTER (ts >= TIMESTAMP '2024-01-23 23:00:00') AS in_hot
      FROM events GROUP BY 1""",
    "cold_compacted": """SELECT event_type AS "index", count(*) AS docs, 1 AS files, min(ts) AS first_ts, max(ts) AS last_ts,
        CAST(sum(event_id) AS BIGINT) AS ids, TIMESTAMP '2024-01-25' AS migrated_before
      FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1""",
    "migrate_with_bad_table": """SELECT event_type AS "index", max(cutoff) AS migrated_before, max(failed) AS failed, 2 - max(failed) AS succeeded,
        count(*) FILTER (ts < cutoff) AS docs, max(ts) FILTER (ts < cutoff) AS last_ts
      FROM (SELECT *, CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-01-17' ELSE TIMESTAMP '2024-01-24' END AS cutoff,
        CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS failed FROM events) GROUP BY 1""",
    "retention_run": f"""SELECT event_type AS "index", count(*) AS docs, min(ts) AS first_ts FROM events
      WHERE {_CUTOFFS} AND CASE WHEN event_type = 'error' THEN true WHEN event_type LIKE 'v%' THEN ts >= TIMESTAMP '2024-01-19'
        ELSE ts >= TIMESTAMP '2024-01-11' END GROUP BY 1""",
    "streaming_copy": f"""SELECT event_id, event_type AS "index", ts, ts < TIMESTAMP '2024-01-10' AND value < 10 AS late
      FROM events WHERE {_CUTOFFS}""",
    "late_by_ledger": """SELECT event_type AS "index", ts < TIMESTAMP '2024-01-10' AND value < 10 AS late, count(*) AS docs,
      count(*) FILTER (value >= 5) AS keyed FROM events WHERE ts < TIMESTAMP '2024-01-24 01:00:00' GROUP BY 1, 2""",
    "search_pruned_by_marks": "SELECT r.name AS \"range\", event_id, event_type AS \"index\", "
    f"CASE WHEN {_CUTOFFS} THEN 'cold' ELSE 'hot' END AS tier FROM events JOIN (VALUES "
    + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in RANGES.items())
    + ") r(name, a, b) ON ts BETWEEN a AND b WHERE event_type LIKE '%r%'",
}
ORACLES["migrate_late_then_purge"] = ORACLES["migrate_stopped_after_purge"] = ORACLES["migrate_and_purge"]
