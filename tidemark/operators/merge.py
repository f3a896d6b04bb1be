"""Order, pages and merged answers across tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIER_RANK = {"hot": 0, "cold": 1}


def score_of(score: Column) -> Column:
    """A missing score counts as zero."""
    return F.coalesce(score, F.lit(0.0))


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "hot", F.lit(TIER_RANK["hot"])).otherwise(F.lit(TIER_RANK["cold"]))


def score_keys(score: str = "score", ascending: bool = False, key: str = "event_id") -> list[Column]:
    """Total order by score: hot before cold on ties, then table and key."""
    value = score_of(F.col(score))
    return [value.asc() if ascending else value.desc(), tier_rank(F.col("tier")), F.col("index"), F.col(key)]


def score_order(rows: DataFrame, score: str = "score", ascending: bool = False, key: str = "event_id") -> DataFrame:
    return rows.orderBy(*score_keys(score, ascending, key))


def page(rows: DataFrame, order: Sequence[Column], from_: int = 0, size: int = 10) -> DataFrame:
    """Rows ``from_`` to ``from_ + size`` of the order; every task keeps only that many."""
    return rows.orderBy(*order).offset(max(from_, 0)).limit(max(size, 0))


def page_summary(rows: DataFrame, page_rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: total over all rows, and the best score *of the page* (null when it is empty)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    best = page_rows.agg(F.max(score_of(F.col(score))).alias("max_score"), F.count(F.lit(1)).alias("hits"))
    facts = total.unionByName(best, allowMissingColumns=True)
    return facts.agg(*[F.max(c).alias(c) for c in ("total", "max_score", "hits")]).withColumn("relation", F.lit("eq"))


def after(order: Sequence[tuple[str, bool]], last: Sequence[object]) -> Column:
    """Rows that come after ``last`` in an order of ``(column, ascending)`` pairs."""
    test, equal_so_far = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(order, last, strict=True):
        column, bound = F.col(name), value if isinstance(value, Column) else F.lit(value)
        test = test | (equal_so_far & ((column > bound) if ascending else (column < bound)))
        equal_so_far = equal_so_far & (column == bound)
    return test


def keyset_page(
    rows: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence[object] | None = None, size: int = 10
) -> DataFrame:
    """The next page after the sort values of the last row seen."""
    if last is not None:
        rows = rows.where(after(order, last))
    return rows.orderBy(*[F.col(n).asc() if asc else F.col(n).desc() for n, asc in order]).limit(size)


def merge_responses(responses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Answers of several tiers per request -> one answer.

    Reads ``tier, took, timed_out, shards, total, relation, max_score``. Totals add up and
    are exact only if all are; the time is the longest one; the shard report is hot's.
    A single answer passes unchanged.
    """
    return responses.groupBy(*by).agg(
        F.max("took").alias("took"),
        F.bool_or("timed_out").alias("timed_out"),
        F.min_by("shards", tier_rank(F.col("tier"))).alias("shards"),
        F.sum("total").alias("total"),
        F.max(F.when(F.col("relation") == "gte", F.lit("gte")).otherwise(F.lit("eq"))).alias("relation"),
        F.max("max_score").alias("max_score"),
    )


def merge_named_aggs(aggs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Named results of several tiers -> one per name; hot wins where both have the name.

    Reads ``tier, agg_name, result``. One grouped pass instead of an outer join, so
    each task reduces its rows first.
    """
    return aggs.groupBy(*by, "agg_name").agg(F.min_by("result", tier_rank(F.col("tier"))).alias("result"))
