"""Run metrics and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros_of

SUCCESS, FAILED = "success", "failed"


def docs_per_sec(documents: Column, duration_sec: Column) -> Column:
    """Rows per second, zero when no time passed."""
    return F.when(duration_sec > 0, documents / duration_sec).otherwise(F.lit(0.0))


def run_metrics(runs: DataFrame, suffix: str = "") -> DataFrame:
    """Metric rows from ``(index, started_at, completed_at, documents_migrated, workers, batch_size, error, cutoff_time)``.

    The id is made of the table and the start second, so recording a run again replaces it; ``suffix`` sets apart what else
    is recorded of the same second.
    """
    micros = micros_of(F.col("completed_at")) - micros_of(F.col("started_at"))
    start_second = F.floor(micros_of(F.col("started_at")) / 1_000_000)
    return runs.withColumn("duration_sec", micros / F.lit(1_000_000.0)).select(
        F.concat(F.lit("metric-"), "index", F.lit("-"), start_second.cast("string"), F.lit(suffix)).alias("metric_id"),
        F.col("completed_at").alias("event_ts"),
        "index",
        "started_at",
        "completed_at",
        "duration_sec",
        "documents_migrated",
        docs_per_sec(F.col("documents_migrated"), F.col("duration_sec")).alias("docs_per_sec"),
        "workers",
        "batch_size",
        F.when(F.col("error").isNull(), F.lit(SUCCESS)).otherwise(F.lit(FAILED)).alias("status"),
        "error",
        "cutoff_time",
    )


def migrated_per_day(metrics: DataFrame) -> DataFrame:
    day = F.date_trunc("day", F.col("event_ts")).cast("timestamp_ntz").alias("day")
    return metrics.groupBy(day).agg(F.sum("documents_migrated").alias("documents_migrated"))


def rate_over_time(metrics: DataFrame, unit: str = "day") -> DataFrame:
    bucket = F.date_trunc(unit, F.col("event_ts")).cast("timestamp_ntz").alias("bucket")
    return metrics.groupBy(bucket).agg(F.avg("docs_per_sec").alias("docs_per_sec"), F.count(F.lit(1)).alias("runs"))


def status_share(metrics: DataFrame) -> DataFrame:
    """Runs and share of runs per status. The statuses are two, so the grouped rows fit anywhere."""
    counts = metrics.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))
    totals = counts.agg(F.collect_list(F.struct("status", "runs")).alias("all"), F.sum("runs").alias("total"))
    return totals.select(F.explode("all").alias("one"), "total").select(
        "one.status", "one.runs", (F.col("one.runs") / F.col("total")).alias("share")
    )


def recent_runs(metrics: DataFrame, size: int = 10) -> DataFrame:
    return metrics.orderBy(F.col("event_ts").desc(), "metric_id").limit(size)
