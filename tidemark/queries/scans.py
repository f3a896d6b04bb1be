"""Scans, name selection and documents."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.documents import unwrap_source, unwrap_source_lenient
from tidemark.functions.names import is_system_name
from tidemark.operators import indices, tiers
from tidemark.queries import data
from tidemark.queries.data import EVENTS_SQL, NOW
from tidemark.sources.files import new_folder
from tidemark.sources.lines import read_documents, write_documents

NAMES = ["events-2024.01.05", " events-2024.01.20 ", "", "events-2024.01.29"]
PATTERNS = ["events-2024.01.0?", "events-2024.01.[12]5", "events-2024.01.1*", "not-there", "events-2024.01.[9-"]
RETENTION_RULES = {
    "events-2024.01.05": 1095,
    "events-2024.01.0*": 2555,
    "events-2024.01.?0": 60,
    "events-2024.*": 90,
    "events-*9": 0,
}
ROW = ["event_id", "index", "ts", "value"]


def hot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.hot_scan(data.events(spark, sf_dir), NOW, data.RETENTION_DAYS).select(*ROW)


def cold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.cold_scan(data.events(spark, sf_dir), NOW, data.RETENTION_DAYS).select(*ROW)


def multi_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.scan(data.events(spark, sf_dir), NAMES).select(*ROW)


def wildcard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = NOW - timedelta(days=data.RETENTION_DAYS)
    return tiers.scan(data.events(spark, sf_dir), PATTERNS, end=end).select(*ROW)


def index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.index_catalog(data.events(spark, sf_dir))


def wildcard_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.resolve(data.catalog(data.events(spark, sf_dir)), PATTERNS)


def user_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog in which some daily tables belong to the store itself."""
    prefix = (
        F.when(F.col("event_type") == "error", F.lit(".internal-"))
        .when(F.col("event_type") == "view", F.lit("security-auditlog-"))
        .when(F.col("event_type") == "click", F.lit("top_queries-"))
        .otherwise(F.concat(F.col("event_type"), F.lit("-")))
    )
    named = data.events(spark, sf_dir).select(F.concat(prefix, F.date_format("ts", "yyyy.MM.dd")).alias("index"))
    return named.where(~is_system_name(F.col("index"))).distinct()


def date_suffix_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy.MM.dd")
    name = (
        F.when(F.col("event_type") == "error", F.lit("errors"))
        .when(F.col("event_type") == "view", F.concat(F.lit("views-"), F.date_format("ts", "yyyy-MM-dd")))
        .when(F.col("event_type") == "click", F.concat(F.lit("clicks-2024.02."), F.date_format("ts", "dd")))
        .otherwise(F.concat(F.col("event_type"), F.lit("-"), day))
    )
    catalog = data.catalog(data.events(spark, sf_dir).withColumn("index", name))
    return indices.ripe(catalog, NOW, data.MIGRATE_DAYS)


def retention_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = data.catalog(data.events(spark, sf_dir))
    return indices.with_retention(catalog, RETENTION_RULES, 365)


def timestamp_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.events(spark, sf_dir).select(
        "event_id",
        F.col("event_type").alias("index"),
        "ts",
        (F.col("ts") + F.expr("interval 90 minutes")).alias("created_at"),
    )
    return indices.with_event_time(rows, {"error": "created_at"}, "ts").select("event_id", "event_ts")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search hits, with the document below ``_source``."""
    source = F.struct("doc_id", "lang", "source", "n_chars", "text")
    hit = F.to_json(
        F.struct(
            F.col("source").alias("_index"), F.col("doc_id").cast("string").alias("_id"), source.alias("_source")
        )
    )
    return data.table(spark, sf_dir, "documents").select("lang", hit.alias("hit"), F.to_json(source).alias("document"))


#: A document with numbers that no binary type holds, blanks, nested braces and an escaped quote.
RAW_SOURCE = '{"price":%d.10, "n" : 1e40%d,"id":12345678901234567890123456789%d,"s":"%s \\" } ]", "l":[ {"a":[]} ,null]}'


def _fields(documents: DataFrame) -> DataFrame:
    parsed = F.from_json("document", "doc_id BIGINT, lang STRING, source STRING, n_chars BIGINT, text STRING")
    return documents.select(parsed.alias("d")).select(
        "d.doc_id", "d.lang", "d.source", "d.n_chars", F.md5("d.text").alias("text_md5")
    )


def unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(_hits(spark, sf_dir).select(unwrap_source(F.col("hit")).alias("document")))


def unwrap_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose numbers, blanks and escapes have to come out as they were written, the last of repeated members."""
    parts = ['{"_id":"x","_source":1, "deep":{"_source":[{}]},"_source" : ', "[SOURCE]", ' ,"z":"}\\","}']
    rows = data.events(spark, sf_dir).select("event_id", "user_id", "event_type")
    source = F.format_string(RAW_SOURCE, F.col("user_id"), F.col("event_id"), F.col("event_id"), F.col("event_type"))
    hit = F.concat(F.lit(parts[0]), source, F.lit(parts[2]))
    return rows.select("event_id", unwrap_source(hit).alias("source"))


def unwrap_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English ones come as hits, French ones as plain documents, the rest as text that is no JSON."""
    mixed = (
        F.when(F.col("lang") == "en", F.col("hit"))
        .when(F.col("lang") == "fr", F.col("document"))
        .otherwise(F.concat(F.lit("plain "), F.col("lang")))
    )
    kept = _hits(spark, sf_dir).select(unwrap_source_lenient(mixed).alias("document"))
    is_plain = F.col("document").startswith("plain ")
    doc_id = F.from_json("document", "doc_id BIGINT").getField("doc_id")
    return kept.select(
        doc_id.alias("doc_id"), F.when(is_plain, F.col("document")).alias("plain")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written one per line, gzipped, and read back."""
    path = new_folder(spark, "documents")
    write_documents(_hits(spark, sf_dir), path, "document", compress=True)
    return _fields(read_documents(spark, path))


QUERIES = {
    "hot_scan": hot_scan,
    "cold_scan": cold_scan,
    "multi_index_scan": multi_index_scan,
    "wildcard_scan": wildcard_scan,
    "index_catalog": index_catalog,
    "wildcard_indices": wildcard_indices,
    "user_indices": user_indices,
    "date_suffix_prune": date_suffix_prune,
    "retention_lookup": retention_lookup,
    "timestamp_field": timestamp_field,
    "unwrap_source": unwrap,
    "unwrap_source_raw": unwrap_raw,
    "unwrap_source_lenient": unwrap_lenient,
    "document_lines": document_lines,
}

_ROW_SQL = 'SELECT event_id, "index", ts, value FROM ' + EVENTS_SQL
_DOCUMENTS_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
_POSITION_SQL = r"""CASE WHEN regexp_full_match("index", 'events-2024\.01\.0.') THEN 0
  WHEN regexp_full_match("index", 'events-2024\.01\.[12]5') THEN 1
  WHEN regexp_full_match("index", 'events-2024\.01\.1.*') THEN 2 END"""

ORACLES = {
    "hot_scan": f"{_ROW_SQL} WHERE ts >= TIMESTAMP '2024-01-21'",
    "cold_scan": f"{_ROW_SQL} WHERE ts < TIMESTAMP '2024-01-21'",
    "multi_index_scan": f"""{_ROW_SQL} WHERE "index" IN ('events-2024.01.05', 'events-2024.01.20', 'events-2024.01.29')""",
    "wildcard_scan": f"{_ROW_SQL} WHERE ts < TIMESTAMP '2024-01-21' AND ({_POSITION_SQL}) IS NOT NULL",
    "index_catalog": f'SELECT DISTINCT "index" FROM {EVENTS_SQL} ORDER BY 1',
    "wildcard_indices": f"""SELECT DISTINCT "index", {_POSITION_SQL} AS position FROM {EVENTS_SQL}
      WHERE ({_POSITION_SQL}) IS NOT NULL UNION ALL SELECT 'not-there', 3""",
    "user_indices": """SELECT DISTINCT event_type || strftime(ts, '-%Y.%m.%d') AS "index" FROM events
      WHERE event_type NOT IN ('error', 'view', 'click')""",
    "date_suffix_prune": """SELECT DISTINCT "index" FROM (SELECT ts, event_type,
        CASE event_type WHEN 'error' THEN 'errors' WHEN 'view' THEN strftime(ts, 'views-%Y-%m-%d')
        WHEN 'click' THEN strftime(ts, 'clicks-2024.02.%d') ELSE event_type || strftime(ts, '-%Y.%m.%d') END AS "index"
        FROM events)
      WHERE event_type = 'error' OR (event_type = 'click' AND day(ts) > 29)
        OR (event_type NOT IN ('error', 'click') AND ts < TIMESTAMP '2024-01-24')""",
    "retention_lookup": f"""SELECT "index", CASE WHEN "index" = 'events-2024.01.05' THEN 1095
        WHEN "index" LIKE 'events-2024.01.0%' THEN 2555 WHEN "index" LIKE 'events-2024.01._0' THEN 60
        WHEN "index" LIKE 'events-2024.%' THEN 90 WHEN "index" LIKE 'events-%9' THEN 0 ELSE 365 END AS cold_days
      FROM (SELECT DISTINCT "index" FROM {EVENTS_SQL})""",
    "timestamp_field": """SELECT event_id,
      CASE WHEN event_type = 'error' THEN ts + INTERVAL 90 MINUTE ELSE ts END AS event_ts FROM events""",
    "unwrap_source": _DOCUMENTS_SQL,
    "unwrap_source_lenient": """SELECT CASE WHEN lang IN ('en', 'fr') THEN doc_id END AS doc_id,
      CASE WHEN lang NOT IN ('en', 'fr') THEN 'plain ' || lang END AS plain FROM documents""",
    "document_lines": _DOCUMENTS_SQL,
    "unwrap_source_raw": f"SELECT event_id, printf('{RAW_SOURCE}', user_id, event_id, event_id, event_type) AS source FROM events",
}
