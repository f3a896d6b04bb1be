"""Run metrics and the four reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.queries import data
from tidemark.queries.data import EVENTS_SQL


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events of one type as one migration run; runs that met a value above 120 failed."""
    rows = data.events(spark, sf_dir)
    runs = rows.groupBy("index", "event_type").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("completed_at"),
        F.count(F.lit(1)).alias("documents_migrated"),
        F.max("value").alias("worst"),
    )
    return runs.select(
        F.concat("index", F.lit("-"), "event_type").alias("index"),
        "started_at",
        "completed_at",
        "documents_migrated",
        F.lit(4).alias("workers"),
        F.lit(5000).alias("batch_size"),
        F.when(F.col("worst") > 120, F.concat(F.lit("value "), F.col("worst").cast("string"))).alias("error"),
        F.date_trunc("day", "started_at").cast("timestamp_ntz").alias("cutoff_time"),
    )


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_metrics(_runs(spark, sf_dir))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select(
        "metric_id", "event_ts", "index", "started_at", "completed_at", "documents_migrated", "workers", "batch_size",
        "status", "error", "cutoff_time",
        F.round("duration_sec", 3).alias("duration_sec"), F.round("docs_per_sec", 6).alias("docs_per_sec"),
    )


def metrics_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.migrated_per_day(_metrics(spark, sf_dir))


def metrics_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.rate_over_time(_metrics(spark, sf_dir))
    return rates.select("bucket", F.round("docs_per_sec", 6).alias("docs_per_sec"), "runs")


def metrics_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_share(_metrics(spark, sf_dir)).select("status", "runs", F.round("share", 6).alias("share"))


def metrics_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent_runs(_metrics(spark, sf_dir), 15).select(
        "metric_id", "event_ts", "status", "documents_migrated"
    )


QUERIES = {
    "run_metrics": run_metrics,
    "metrics_daily": metrics_daily,
    "metrics_rate": metrics_rate,
    "metrics_status": metrics_status,
    "metrics_recent": metrics_recent,
}

_RUNS_SQL = f"""(SELECT 'metric-' || "index" || '-' || event_type || '-' || CAST(CAST(floor(epoch(started_at)) AS BIGINT) AS VARCHAR) AS metric_id,
    completed_at AS event_ts, "index" || '-' || event_type AS "index", started_at, completed_at, documents_migrated,
    4 AS workers, 5000 AS batch_size, CASE WHEN worst > 120 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN worst > 120 THEN 'value ' || CAST(worst AS VARCHAR) END AS error,
    CAST(date_trunc('day', started_at) AS TIMESTAMP) AS cutoff_time,
    (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0 AS duration_sec,
    CASE WHEN completed_at > started_at THEN documents_migrated / ((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0)
      ELSE 0.0 END AS docs_per_sec
  FROM (SELECT "index", event_type, min(ts) AS started_at, max(ts) AS completed_at, count(*) AS documents_migrated,
    max(value) AS worst FROM {EVENTS_SQL} GROUP BY ALL))"""

ORACLES = {
    "run_metrics": f"""SELECT * REPLACE (round(duration_sec, 3) AS duration_sec, round(docs_per_sec, 6) AS docs_per_sec)
      FROM {_RUNS_SQL}""",
    "metrics_daily": f"""SELECT CAST(date_trunc('day', event_ts) AS TIMESTAMP) AS day,
      CAST(sum(documents_migrated) AS BIGINT) AS documents_migrated FROM {_RUNS_SQL} GROUP BY 1""",
    "metrics_rate": f"""SELECT CAST(date_trunc('day', event_ts) AS TIMESTAMP) AS bucket,
      round(avg(docs_per_sec), 6) AS docs_per_sec, count(*) AS runs FROM {_RUNS_SQL} GROUP BY 1""",
    "metrics_status": f"""SELECT status, count(*) AS runs,
      round(count(*) / CAST((SELECT count(*) FROM {_RUNS_SQL}) AS DOUBLE), 6) AS share FROM {_RUNS_SQL} GROUP BY 1""",
    "metrics_recent": f"""SELECT metric_id, event_ts, status, documents_migrated FROM {_RUNS_SQL}
      ORDER BY event_ts DESC, metric_id LIMIT 15""",
}
