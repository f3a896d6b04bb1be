"""Order, pages, totals and aggregates across tiers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, merge, metrics, tiers
from tidemark.plans.search import needed_tiers, search, tiered_rows

HIT = "tier STRING, index STRING, event_id INT, score DOUBLE"
B = datetime(2026, 1, 1)


def hits(spark, *rows):
    return spark.createDataFrame([(t, "i", n, s) for n, (t, s) in enumerate(rows)], HIT)


def scores(df):
    return [r.score for r in df.collect()]


def test_score_order(spark):
    df = hits(spark, ("cold", 1.2), ("hot", 1.5), ("hot", 1.0))
    assert scores(merge.score_order(df)) == [1.5, 1.2, 1.0]
    assert scores(merge.score_order(df, ascending=True)) == [1.0, 1.2, 1.5]


def test_ties_keep_hot_first_and_missing_scores_are_zero(spark):
    df = hits(spark, ("cold", 1.0), ("hot", 1.0), ("hot", None), ("cold", -1.0))
    assert [r.event_id for r in merge.score_order(df).collect()] == [1, 0, 2, 3]


def test_pages(spark):
    df = hits(spark, ("hot", 3.0), ("hot", 1.0), ("cold", 2.0), ("cold", 0.0))
    page = merge.page(df, merge.score_keys(), 1, 2)
    assert scores(page) == [2.0, 1.0]
    summary = merge.page_summary(df, page).first()
    assert (summary.total, summary.max_score, summary.hits, summary.relation) == (4, 2.0, 2, "eq")
    assert scores(merge.page(df, merge.score_keys(), 9, 2)) == []
    assert scores(merge.page(df, merge.score_keys(), -1, 1)) == [3.0]
    empty = merge.page(df, merge.score_keys(), 0, 0)
    summary = merge.page_summary(df, empty).first()
    assert (summary.total, summary.max_score, summary.hits) == (4, None, 0)


def test_keyset_pages_tile_the_order(spark):
    df = hits(spark, *[("hot", float(i % 4)) for i in range(23)])
    order, last, seen = [("score", False), ("event_id", True)], None, []
    while page := merge.keyset_page(df, order, last, 5).collect():
        seen += [r.event_id for r in page]
        last = (page[-1].score, page[-1].event_id)
    assert seen == [r.event_id for r in df.orderBy(F.col("score").desc(), "event_id").collect()]


def test_merge_responses(spark):
    rows = [
        (1, "hot", 10, False, "h", 2, "eq", 1.5),
        (1, "cold", 20, True, "c", 1, "eq", 1.2),
        (2, "hot", 1, False, "h", 10, "gte", None),
        (2, "cold", 1, False, "c", 5, "eq", None),
        (3, "cold", 7, False, "c", 5, "eq", 0.5),
    ]
    df = spark.createDataFrame(rows, "req INT, tier STRING, took INT, timed_out BOOLEAN, shards STRING, total BIGINT, relation STRING, max_score DOUBLE")
    got = {r.req: tuple(r)[1:] for r in merge.merge_responses(df, ["req"]).collect()}
    assert got == {1: (20, True, "h", 3, "eq", 1.5), 2: (1, False, "h", 15, "gte", None), 3: (7, False, "c", 5, "eq", 0.5)}


def test_merge_named_aggs(spark):
    df = spark.createDataFrame([(1, "hot", "a", "h"), (1, "cold", "a", "c"), (1, "cold", "b", "c")], "req INT, tier STRING, agg_name STRING, result STRING")
    assert {(r.agg_name, r.result) for r in merge.merge_named_aggs(df, ["req"]).collect()} == {("a", "h"), ("b", "c")}


def events(spark, n=200):
    return spark.range(n).selectExpr(
        "CAST(id AS INT) AS event_id",
        "concat('t', id % 3) AS index",
        "TIMESTAMP_NTZ'2025-12-20 00:00:00' + make_dt_interval(0, CAST(id * 2 AS INT)) AS ts",
        "CAST(id % 17 AS DOUBLE) AS score",
    )


def test_bag_union_counts_twice_and_exact_union_once(spark):
    rows = events(spark)
    assert tiers.union_all(rows, rows.where("event_id < 50")).count() == 250
    for boundary in (datetime(2025, 12, 1), B - timedelta(days=5, hours=3), datetime(2026, 2, 1)):
        cold = rows.where(F.col("ts") < F.lit(boundary.isoformat(sep=" ")).cast("timestamp_ntz"))
        exact = tiers.union_exact(rows, cold, boundary)
        assert sorted(r.event_id for r in exact.collect()) == list(range(200))


def test_exact_union_with_a_mark_per_table(spark):
    rows = events(spark)
    marks = spark.sql("SELECT 't0' AS index, TIMESTAMP_NTZ'2025-12-25 01:00:00' AS migrated_before UNION ALL SELECT 't1', TIMESTAMP_NTZ'2026-01-03 00:00:00'")
    cold = rows.join(marks, "index").where("ts < migrated_before AND event_id <> 3").drop("migrated_before")
    assert 3 not in {r.event_id for r in tiers.union_exact(rows, cold, marks).collect()}
    shown = tiers.union_exact(rows, cold, marks, include_late=True).collect()
    assert sorted(r.event_id for r in shown) == list(range(200))
    assert {r["index"] for r in shown if r.tier == "cold"} == {"t0", "t1"}
    assert [r.event_id for r in tiers.late_rows(rows, cold, marks).collect()] == [3]


def test_aggregates_count_every_row_once(spark):
    rows = events(spark)
    both = tiers.union_exact(rows, rows, B)
    assert sum(r.doc_count for r in aggregates.terms(both, ["index"]).collect()) == 200
    assert sum(r.doc_count for r in aggregates.date_histogram(both).collect()) == 200


@pytest.mark.parametrize(
    "range_from,range_to,expected",
    [
        (None, None, (True, True)),
        (B, None, (True, False)),
        (B - timedelta(1), None, (True, True)),
        (None, B - timedelta(1), (False, True)),
        (None, B, (True, True)),
    ],
)
def test_needed_tiers(range_from, range_to, expected):
    assert needed_tiers(B, range_from, range_to) == expected


def test_search_equals_plain_sort(spark):
    rows = events(spark)
    lo, hi = datetime(2025, 12, 28), datetime(2026, 1, 3)
    page, summary = search(
        rows.withColumn("score", F.col("score")), rows.where("ts < '2026-01-01'"), B, from_=3, size=7, range_from=lo, range_to=hi, indices=["t[01]"]
    )
    kept = [r for r in rows.collect() if lo <= r.ts <= hi and r["index"] in ("t0", "t1")]
    rank = sorted(kept, key=lambda r: (-r.score, 0 if r.ts >= B else 1, r["index"], r.event_id))
    assert [r.event_id for r in page.collect()] == [r.event_id for r in rank[3:10]]
    assert summary.first().total == len(kept)


def test_missing_columns_are_null(spark):
    hot = spark.createDataFrame([(1, "x")], "event_id INT, extra STRING")
    cold = spark.createDataFrame([(2,)], "event_id INT")
    assert {(r.event_id, r.extra) for r in tiers.union_all(hot, cold).collect()} == {(1, "x"), (2, None)}


def test_metric_rows(spark):
    rows = [
        ("sales", datetime(2025, 3, 9, 12), datetime(2025, 3, 9, 12, 1, 30), 7200, 3, 800, None, B),
        ("sales", datetime(2025, 3, 9, 13), datetime(2025, 3, 9, 13), 0, 3, 800, "disk full", B),
    ]
    runs = spark.createDataFrame(
        rows,
        "index STRING, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, documents_migrated BIGINT, workers INT, batch_size INT, error STRING, cutoff_time TIMESTAMP_NTZ",
    )
    done = metrics.run_metrics(runs)
    good, bad = done.orderBy("started_at").collect()
    assert (good.duration_sec, good.docs_per_sec, good.status, good.error) == (90.0, 80.0, "success", None)
    assert (bad.docs_per_sec, bad.status, bad.error) == (0.0, "failed", "disk full")
    assert good.metric_id == "metric-sales-1741521600"
    assert metrics.migrated_per_day(done).first().documents_migrated == 7200
    assert {r.status: r.share for r in metrics.status_share(done).collect()} == {"success": 0.5, "failed": 0.5}
    assert metrics.recent_runs(done, 1).first().status == "failed"
    assert metrics.rate_over_time(done).first().docs_per_sec == 40.0


def test_plans(spark, tmp_path):
    rows = events(spark)
    for name, part in (("hot", rows), ("cold", rows.where("ts < '2026-01-01'"))):
        part.write.partitionBy("index").parquet(str(tmp_path / name))
    hot, cold = (spark.read.parquet(str(tmp_path / name)) for name in ("hot", "cold"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    only_cold = plan(tiered_rows(hot, cold, B, range_to=datetime(2025, 12, 25)))
    assert f"{tmp_path}/cold" in only_cold and f"{tmp_path}/hot" not in only_cold
    named = plan(tiers.scan(hot, ["t[0]", "t2"], start=B))
    assert "PartitionFilters: [isnotnull(index" in named or "RLIKE" in named.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(ts,2026-01-01T00:00)" in named
    exact = tiered_rows(hot, cold, B)
    assert "Exchange" not in plan(exact)
    assert "TakeOrderedAndProject" in plan(merge.page(exact, merge.score_keys(), 5, 5))
