"""Choosing tables by name, and settings that hang on the name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names


def resolve(catalog: DataFrame, patterns: Sequence[str], hide_system: bool = False) -> DataFrame:
    """Tables selected by a list of names and wildcards: ``(index, position)``, each table once.

    ``position`` is the place of the first pattern that selects it. A plain name is
    passed through whether or not the catalog has it.
    """
    cleaned = [p.strip() for p in patterns if p.strip()]
    spark = catalog.sparkSession
    position = None
    for place, pattern in enumerate(cleaned):
        name = F.col("index")
        if names.has_wildcard(pattern):
            test = names.matches_wildcard(name, pattern)
            if hide_system:
                test = test & ~names.is_system_name(name)
        else:
            test = name == pattern
        position = F.when(test, F.lit(place)) if position is None else position.when(test, F.lit(place))
    plain = [p for p in cleaned if not names.has_wildcard(p)]
    named = spark.createDataFrame([(p,) for p in plain], "index STRING")
    candidates = catalog.select("index").union(named)
    if position is None:
        return candidates.where(F.lit(False)).withColumn("position", F.lit(0))
    return candidates.withColumn("position", position).where(F.col("position").isNotNull()).distinct()


def expand_names(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(pattern)`` x catalog -> ``(pattern, index)`` for patterns that are data.

    Plain names stand for themselves. A wildcard is joined to the names that share the
    text before its first wildcard character, an equi-join on prefixes, and only
    those candidates are matched.
    """
    wanted = requested.select("pattern").distinct()
    plain = wanted.where(~names.is_wildcard_column(F.col("pattern"))).select("pattern", F.col("pattern").alias("index"))
    prefixed = catalog.select(
        "index",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.length("index")), lambda n: F.substring(F.col("index"), F.lit(1), n))
        ).alias("_prefix"),
    )
    wild = (
        wanted.where(names.is_wildcard_column(F.col("pattern")))
        .withColumn("_prefix", names.literal_prefix(F.col("pattern")))
        .withColumn("_regex", names.wildcard_regex_column(F.col("pattern")))
        .join(prefixed, "_prefix")
        .where(F.rlike("index", F.col("_regex")))
        .select("pattern", "index")
    )
    return plain.union(wild)


def with_retention(catalog: DataFrame, rules: Mapping[str, int], default: int) -> DataFrame:
    """Add ``cold_days``, the days each table stays in the cold tier (0 = for ever)."""
    return catalog.withColumn("cold_days", names.cold_days(F.col("index"), rules, default))


def with_event_time(rows: DataFrame, fields: Mapping[str, str], default: str, name: str = "event_ts") -> DataFrame:
    """Add one common time column from the column each table keeps its time in."""
    chosen = names.per_index(F.col("index"), fields, default)
    value = None
    for field in dict.fromkeys([*fields.values(), default]):
        test = chosen == field
        value = F.when(test, F.col(f"`{field}`")) if value is None else value.when(test, F.col(f"`{field}`"))
    return rows.withColumn(name, value)


def ripe(catalog: DataFrame, now: datetime, migrate_after_days: int) -> DataFrame:
    """Tables that can hold rows to migrate, judged by the date in their name."""
    return catalog.where(names.ripe_name(F.col("index"), now, migrate_after_days))


def index_catalog_of(rows: DataFrame) -> DataFrame:
    """Distinct table names of some rows, unordered."""
    return rows.select("index").distinct()
