"""Request-log analysis: time range, tier and mergeability of every logged search."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bodies
from tidemark.functions.names import is_wildcard_column

DEFAULT_FIELD = "@timestamp"


def with_time_range(
    requests: DataFrame, now: datetime, field: Column | str = DEFAULT_FIELD, body: str = "body"
) -> DataFrame:
    """Add ``range_from, range_to, from_open, to_open`` (all null when the request names no range)."""
    name = F.lit(field) if isinstance(field, str) else field
    return (
        requests.withColumn("_parsed", bodies.parsed(F.col(body)))
        .withColumn("_range", bodies.time_range(F.col("_parsed"), name, now))
        .select("*", "_range.*")
        .drop("_parsed", "_range")
    )


def with_route(
    requests: DataFrame,
    now: datetime,
    retention_days: int,
    ts_fields: Mapping[str, str] | None = None,
    default_field: str = DEFAULT_FIELD,
    indices: str | None = None,
    body: str = "body",
) -> DataFrame:
    """Add ``route``, without ``indices`` along with the time range it comes from.

    With an ``indices`` array column every table is routed by its own time field.
    """
    if indices is None:
        ranged = with_time_range(requests, now, default_field, body)
        return ranged.withColumn(
            "route", bodies.route_of_range(F.col("range_from"), F.col("range_to"), now, retention_days)
        )
    route = bodies.route_of_indices(
        F.col("_parsed"), F.col(indices), ts_fields or {}, default_field, now, retention_days
    )
    return (
        requests.withColumn("_parsed", bodies.parsed(F.col(body))).withColumn("route", route).drop("_parsed")
    )


def with_paging(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add the ``bodies.paging`` columns."""
    return (
        requests.withColumn("_parsed", bodies.parsed(F.col(body)))
        .withColumn("_paging", bodies.paging(F.col("_parsed")))
        .select("*", "_paging.*")
        .drop("_parsed", "_paging")
    )


def with_outcome(requests: DataFrame) -> DataFrame:
    """Add what becomes of each request in a store that merges by score only.

    Reads ``route, mergeable, indices, endpoint`` (``search`` or ``msearch``).
    A search over both tiers that cannot be merged is answered from hot alone, one
    over several cold tables is an error; inside a multi-search both are errors.
    """
    names = F.col("indices")
    several = F.size(names) > 1
    wildcard = F.exists(names, is_wildcard_column)
    searching = F.col("endpoint") == "search"
    cold_merge = (F.col("route") == bodies.COLD) & (several | (searching & wildcard))
    needs_merge = (F.col("route") == bodies.BOTH) | cold_merge
    outcome = (
        F.when(~needs_merge, F.lit("single_tier"))
        .when(F.col("mergeable"), F.lit("merged"))
        .when(searching & (F.col("route") == bodies.BOTH), F.lit("hot_results_only"))
        .otherwise(F.lit("error_400"))
    )
    return requests.withColumn("needs_merge", needs_merge).withColumn("outcome", outcome)
