"""Unions, order, pages, merged answers and aggregates over both tiers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.documents import merge_agg_json, merge_agg_maps
from tidemark.operators import aggregates, merge, tiers
from tidemark.plans.search import search, tiered_rows
from tidemark.queries import data
from tidemark.queries.data import BEHIND_MARK_SQL, EVENTS_SQL, MIGRATE_CUTOFF

SEARCH_FROM, SEARCH_TO = datetime(2024, 1, 18, 6), datetime(2024, 1, 27, 12)
LAST_SEEN = (50.0, 5000)


def _union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.union_all(*data.overlapping_tiers(spark, sf_dir))


def _exact(spark: SparkSession, sf_dir: str, include_late: bool = False) -> DataFrame:
    hot, cold, marks = data.both_tiers(data.events(spark, sf_dir))
    return tiers.union_exact(hot, cold, marks, include_late=include_late)


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tiers meeting at one moment, of tiers that overlap by three days."""
    return tiered_rows(*data.overlapping_tiers(spark, sf_dir), MIGRATE_CUTOFF).withColumn("score", F.col("value"))


def tier_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union_all(spark, sf_dir).select("event_id", "tier", "index", "value")


def tier_union_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir).select("event_id", "tier", "index", "value")


def tier_union_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events arrived behind the mark and were never copied."""
    hot, cold, marks = data.both_tiers(data.events(spark, sf_dir))
    cold = cold.where("event_type <> 'error'")
    return tiers.union_exact(hot, cold, marks, include_late=True).select("event_id", "tier", "index", "value")


def score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _union_all(spark, sf_dir).withColumn("score", F.col("value"))
    return merge.score_order(rows).select("event_id", "tier", "index", "score")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = merge.page(_fixed(spark, sf_dir), merge.score_keys(), 20, 10)
    return hits.select("event_id", "tier", "index", "score")


def page_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag union paged by lowest score: rows in both tiers take two places."""
    rows = _union_all(spark, sf_dir).withColumn("score", F.col("value"))
    return merge.page(rows, merge.score_keys(ascending=True), 5, 25).select("event_id", "tier", "index", "score")


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixed(spark, sf_dir)
    return merge.page_summary(rows, merge.page(rows, merge.score_keys(), 20, 10))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [("score", False), ("event_id", True)]
    hits = merge.keyset_page(_fixed(spark, sf_dir), order, LAST_SEEN, 25)
    return hits.select("event_id", "tier", "index", "score")


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hot, cold = (t.withColumn("score", F.col("value")) for t in data.overlapping_tiers(spark, sf_dir))
    return search(
        hot,
        cold,
        MIGRATE_CUTOFF,
        order=[F.col("ts").desc(), F.col("event_id")],
        from_=5,
        size=40,
        range_from=SEARCH_FROM,
        range_to=SEARCH_TO,
        indices=["events-2024.01.*"],
        predicate=(F.col("event_type") == "error") & F.col("props").contains("9"),
    )


def tier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)[0].select("event_id", "tier", "index", "ts", "props")


def tier_search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)[1]


def tier_search_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that ends before the boundary: hot is not part of the plan."""
    hot, cold = (t.withColumn("score", F.col("value")) for t in data.overlapping_tiers(spark, sf_dir))
    hits, _ = search(hot, cold, MIGRATE_CUTOFF, size=15, range_to=datetime(2024, 1, 10))
    return hits.select("event_id", "tier", "index", "score")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tier answers when every user's events are asked for."""
    return (
        _union_all(spark, sf_dir)
        .groupBy("user_id", "tier")
        .agg(
            F.max("event_id").alias("took"),
            F.bool_or(F.col("value") > 100).alias("timed_out"),
            F.count(F.lit(1)).alias("total"),
            F.max("value").alias("max_score"),
            F.countDistinct("index").alias("tables"),
        )
        .withColumn("shards", F.concat("tier", F.lit("/"), F.col("tables").cast("string")))
        .withColumn("relation", F.when(F.col("total") >= 35, F.lit("gte")).otherwise(F.lit("eq")))
    )


def merge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge_responses(_responses(spark, sf_dir), ["user_id"])
    return merged.select("user_id", "total", "relation", "max_score")


def merge_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge_responses(_responses(spark, sf_dir), ["user_id"])
    return merged.select("user_id", "took", "timed_out", "shards")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per user, tier and event type."""
    counts = _union_all(spark, sf_dir).groupBy("user_id", "tier", F.col("event_type").alias("agg_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("result", F.concat(F.lit('{"doc_count":'), F.col("n").cast("string"), F.lit("}")))


def merge_named_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_named_aggs(_named(spark, sf_dir), ["user_id"])


def _per_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per user as one map per tier; users missing in a tier have none there."""

    def entries(tier: str):
        named = F.when(F.col("tier") == tier, F.struct("agg_name", "result"))
        return F.map_from_entries(F.collect_list(named))

    return _named(spark, sf_dir).groupBy("user_id").agg(entries("hot").alias("hot"), entries("cold").alias("cold"))


def merge_agg_maps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _per_tier(spark, sf_dir).select("user_id", merge_agg_maps(F.col("hot"), F.col("cold")).alias("merged"))
    return merged.select("user_id", F.explode("merged").alias("agg_name", "result"))


def merge_agg_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on JSON text, where one user's hot answer is a list and so stands alone."""
    def as_json(side: str):
        parts = F.transform(
            F.map_entries(side), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])
        )
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    hot = F.when(F.col("user_id") == 7, F.lit("[1]")).otherwise(as_json("hot"))
    merged = _per_tier(spark, sf_dir).select("user_id", merge_agg_json(hot, as_json("cold")).alias("merged"))
    members = F.try_variant_get(F.try_parse_json("merged"), "$", "map<string,variant>")
    return merged.select("user_id", "merged", F.explode_outer(members).alias("agg_name", "one")).select(
        "user_id",
        "agg_name",
        F.try_variant_get("one", "$.doc_count", "bigint").alias("doc_count"),
        F.when(F.col("agg_name").isNull(), F.col("merged")).alias("other"),
    )


def tier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.terms(
        _exact(spark, sf_dir), ["event_type"], F.max("value").alias("max_value"), F.min("ts").alias("first_ts")
    )


def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.date_histogram(_exact(spark, sf_dir), "day", F.max("value").alias("max_value"), by=["tier"])


QUERIES = {
    "tier_union_all": tier_union_all,
    "tier_union_exact": tier_union_exact,
    "tier_union_late": tier_union_late,
    "score_order": score_order,
    "page": page,
    "page_ascending": page_ascending,
    "page_summary": page_summary,
    "keyset_page": keyset_page,
    "tier_search": tier_search,
    "tier_search_summary": tier_search_summary,
    "tier_search_cold": tier_search_cold,
    "merge_totals": merge_totals,
    "merge_envelope": merge_envelope,
    "merge_named_aggs": merge_named_aggs,
    "merge_agg_maps": merge_agg_maps_query,
    "merge_agg_json": merge_agg_json_query,
    "tier_terms": tier_terms,
    "tier_histogram": tier_histogram,
}

_HOT, _COLD = "ts >= TIMESTAMP '2024-01-21'", "ts < TIMESTAMP '2024-01-24'"
_ALL_SQL = f"""(SELECT *, 'hot' AS tier FROM {EVENTS_SQL} WHERE {_HOT}
  UNION ALL SELECT *, 'cold' AS tier FROM {EVENTS_SQL} WHERE {_COLD})"""
_EXACT_SQL = f"""(SELECT *, CASE WHEN {BEHIND_MARK_SQL} THEN 'cold' ELSE 'hot' END AS tier FROM {EVENTS_SQL})"""
_FIXED_SQL = f"""(SELECT *, value AS score, CASE WHEN {_COLD} THEN 'cold' ELSE 'hot' END AS tier FROM {EVENTS_SQL})"""
_HIT_SQL = 'SELECT event_id, tier, "index", score FROM'
_RANK_SQL = "CASE tier WHEN 'hot' THEN 0 ELSE 1 END"
_SCORE_SQL = f'ORDER BY score DESC, {_RANK_SQL}, "index", event_id'
_FOUND_SQL = f"""(SELECT * FROM {_FIXED_SQL} WHERE event_type = 'error' AND props LIKE '%9%'
  AND ts >= TIMESTAMP '2024-01-18 06:00:00' AND ts <= TIMESTAMP '2024-01-27 12:00:00')"""
_RESPONSES_SQL = f"""(SELECT *, tier || '/' || CAST(tables AS VARCHAR) AS shards,
    CASE WHEN total >= 35 THEN 'gte' ELSE 'eq' END AS relation
  FROM (SELECT user_id, tier, max(event_id) AS took, bool_or(value > 100) AS timed_out, count(*) AS total,
    max(value) AS max_score, count(DISTINCT "index") AS tables FROM {_ALL_SQL} GROUP BY ALL))"""
_NAMED_SQL = f"""(SELECT user_id, tier, event_type AS agg_name, count(*) AS n FROM {_ALL_SQL} GROUP BY ALL)"""
_MERGED_SQL = f"""(SELECT coalesce(h.user_id, c.user_id) AS user_id, coalesce(h.agg_name, c.agg_name) AS agg_name,
    coalesce(h.n, c.n) AS n
  FROM (SELECT * FROM {_NAMED_SQL} WHERE tier = 'hot') h
  FULL JOIN (SELECT * FROM {_NAMED_SQL} WHERE tier = 'cold') c USING (user_id, agg_name))"""
_MERGED_TEXT_SQL = (
    "SELECT user_id, agg_name, '{\"doc_count\":' || CAST(n AS VARCHAR) || '}' AS result FROM " + _MERGED_SQL
)

ORACLES = {
    "tier_union_all": f'SELECT event_id, tier, "index", value FROM {_ALL_SQL}',
    "tier_union_exact": f'SELECT event_id, tier, "index", value FROM {_EXACT_SQL}',
    "tier_union_late": f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'hot' ELSE tier END AS tier,
      "index", value FROM {_EXACT_SQL}""",
    "score_order": f'SELECT event_id, tier, "index", value AS score FROM {_ALL_SQL} ORDER BY score DESC, {_RANK_SQL}, "index", event_id',
    "page": f"{_HIT_SQL} {_FIXED_SQL} {_SCORE_SQL} LIMIT 10 OFFSET 20",
    "page_ascending": f"""SELECT event_id, tier, "index", value AS score FROM {_ALL_SQL}
      ORDER BY value, {_RANK_SQL}, "index", event_id LIMIT 25 OFFSET 5""",
    "page_summary": f"""SELECT (SELECT count(*) FROM events) AS total, max(score) AS max_score, count(*) AS hits,
      'eq' AS relation FROM ({_HIT_SQL} {_FIXED_SQL} {_SCORE_SQL} LIMIT 10 OFFSET 20)""",
    "keyset_page": f"""{_HIT_SQL} {_FIXED_SQL} WHERE score < 50.0 OR (score = 50.0 AND event_id > 5000)
      ORDER BY score DESC, event_id LIMIT 25""",
    "tier_search": f"""SELECT event_id, tier, "index", ts, props FROM {_FOUND_SQL}
      ORDER BY ts DESC, event_id LIMIT 40 OFFSET 5""",
    "tier_search_summary": f"""SELECT (SELECT count(*) FROM {_FOUND_SQL}) AS total, max(score) AS max_score,
      count(*) AS hits, 'eq' AS relation
      FROM (SELECT * FROM {_FOUND_SQL} ORDER BY ts DESC, event_id LIMIT 40 OFFSET 5)""",
    "tier_search_cold": f"{_HIT_SQL} {_FIXED_SQL} WHERE ts <= TIMESTAMP '2024-01-10' {_SCORE_SQL} LIMIT 15",
    "merge_totals": f"""SELECT user_id, CAST(sum(total) AS BIGINT) AS total, max(relation) AS relation,
      max(max_score) AS max_score FROM {_RESPONSES_SQL} GROUP BY user_id""",
    "merge_envelope": f"""SELECT user_id, max(took) AS took, bool_or(timed_out) AS timed_out,
      coalesce(max(shards) FILTER (tier = 'hot'), max(shards)) AS shards FROM {_RESPONSES_SQL} GROUP BY user_id""",
    "merge_named_aggs": _MERGED_TEXT_SQL,
    "merge_agg_maps": _MERGED_TEXT_SQL,
    "merge_agg_json": f"""SELECT user_id, agg_name, n AS doc_count, CAST(NULL AS VARCHAR) AS other
      FROM {_MERGED_SQL} WHERE user_id <> 7
      UNION ALL SELECT DISTINCT user_id, NULL, NULL, '[1]' FROM events WHERE user_id = 7""",
    "tier_terms": """SELECT event_type, count(*) AS doc_count, max(value) AS max_value, min(ts) AS first_ts
      FROM events GROUP BY event_type""",
    "tier_histogram": f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, tier, count(*) AS doc_count,
      max(value) AS max_value FROM {_EXACT_SQL} GROUP BY ALL""",
}
