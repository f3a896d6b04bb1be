"""Keyed state: high-water marks, slice progress and run metrics.

A state table is an append-only Parquet log. Putting a row appends it; reading
takes the newest row per key, so a repeated put replaces the earlier one and no
file that is being read is ever overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import read_table, remove_files

WATERMARK = "index STRING, migrated_before TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
PURGE_MARK = "index STRING, purged_before TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
SLICE_STATE = (
    "index STRING, cutoff_time TIMESTAMP_NTZ, slice_max INT, slice_id INT, "
    "migrated BIGINT, done BOOLEAN, updated_at TIMESTAMP_NTZ"
)
HOT_FILES = (
    "file STRING, index STRING, late_before TIMESTAMP_NTZ, batch STRING, done BOOLEAN, updated_at TIMESTAMP_NTZ"
)
RUN_METRICS = (
    "metric_id STRING, event_ts TIMESTAMP_NTZ, index STRING, started_at TIMESTAMP_NTZ, "
    "completed_at TIMESTAMP_NTZ, duration_sec DOUBLE, documents_migrated BIGINT, docs_per_sec DOUBLE, "
    "workers INT, batch_size INT, status STRING, error STRING, cutoff_time TIMESTAMP_NTZ"
)

KEYS = {
    "watermark": ["index"],
    "purge_mark": ["index"],
    "slice_state": ["index", "cutoff_time", "slice_max", "slice_id"],
    "run_metrics": ["metric_id"],
    "hot_files": ["file"],
}
SCHEMAS = {
    "watermark": WATERMARK,
    "purge_mark": PURGE_MARK,
    "slice_state": SLICE_STATE,
    "run_metrics": RUN_METRICS,
    "hot_files": HOT_FILES,
}
VERSIONS = {
    "watermark": "updated_at", "purge_mark": "updated_at", "slice_state": "updated_at", "run_metrics": "event_ts",
    "hot_files": "updated_at",
}


def newest_by_key(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the one with the highest version, remaining columns breaking ties.

    A maximum of structs, so every task first reduces its own rows to one per key.
    """
    rest = [c for c in rows.columns if c not in keys and c != version]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old rows with the new ones put over them by key."""
    return newest_by_key(old.unionByName(new), keys, version)


def put_state(rows: DataFrame, root: str, table: str) -> None:
    columns = [f.strip().split(" ")[0] for f in SCHEMAS[table].split(", ")]
    rows.select(*columns).write.mode("append").parquet(f"{root}/state/{table}")


def get_state(spark: SparkSession, root: str, table: str) -> DataFrame:
    rows = read_table(spark, f"{root}/state/{table}", SCHEMAS[table])
    return newest_by_key(rows, KEYS[table], VERSIONS[table])


def fold_state(spark: SparkSession, root: str, table: str) -> None:
    """Shorten a log to the newest row of each key.

    Those rows are appended first and the files they came from deleted after: a row that is there twice
    is the same newest row, so a crash between any two steps changes nothing that is read.
    """
    rows = read_table(spark, f"{root}/state/{table}", SCHEMAS[table])
    old = rows.inputFiles()
    if len(old) > 1:
        put_state(newest_by_key(rows, KEYS[table], VERSIONS[table]), root, table)
        remove_files(spark, old)


def open_slices(slice_state: DataFrame, watermark: DataFrame) -> DataFrame:
    """Slices of runs that have not finished.

    A run is complete once the high-water mark of its table has reached its cutoff;
    its slices then read as if there were none.
    """
    marks = watermark.select("index", "migrated_before")
    unfinished = F.col("migrated_before").isNull() | (F.col("cutoff_time") > F.col("migrated_before"))
    return slice_state.join(marks, "index", "left").where(unfinished).drop("migrated_before")
