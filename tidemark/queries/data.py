"""The given tables as tiered tables and request logs.

``events`` is the tiered table: a daily table per date, ``value`` as score, ``props`` as
document. The moment ``now`` is fixed so that results repeat.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import daily_name, index_date
from tidemark.functions.times import ts_literal
from tidemark.operators.indices import index_catalog_of
from tidemark.sources.files import settled

NOW = datetime(2024, 1, 31)
RETENTION_DAYS = 10
MIGRATE_DAYS = 7
COLD_DAYS = 20
SLICES = 4
RETENTION_CUTOFF = NOW - timedelta(days=RETENTION_DAYS)
MIGRATE_CUTOFF = NOW - timedelta(days=MIGRATE_DAYS)
LAST_MARK = datetime(2024, 1, 23, 18)

# The same rows for the SQL side.
EVENTS_SQL = """(SELECT *, strftime(ts, 'events-%Y.%m.%d') AS "index" FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal a table that is a few small files out to all cores, for work that is heavy per row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rows.withColumn("index", daily_name("events-", F.col("ts")))


def overlapping_tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hot holds ten days, cold all that is older than seven."""
    rows = events(spark, sf_dir)
    return rows.where(F.col("ts") >= ts_literal(RETENTION_CUTOFF)), rows.where(F.col("ts") < ts_literal(MIGRATE_CUTOFF))


def catalog(rows: DataFrame) -> DataFrame:
    """Names of the tables, settled: filters on names then read every name once, not every row's."""
    return settled(index_catalog_of(rows), "catalog")


def marks(rows: DataFrame) -> DataFrame:
    """Marks of a run that reached all daily tables up to the 23rd but those of every fifth day."""
    day = index_date(F.col("index"))
    reached = (day <= F.lit(LAST_MARK.date())) & (F.dayofmonth(day) % 5 != 0)
    named = index_catalog_of(rows).withColumn("migrated_before", F.when(reached, ts_literal(LAST_MARK)))
    return settled(named, "marks").where("migrated_before IS NOT NULL")


# SQL condition: a row of E lies behind the mark of its table.
BEHIND_MARK_SQL = "(day(ts) % 5 <> 0 AND ts < TIMESTAMP '2024-01-23 18:00:00')"


def both_tiers(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hot with nothing purged, cold with what lies behind the marks, and the marks."""
    known = marks(rows)
    cold = rows.join(known, "index").where(F.col("ts") < F.col("migrated_before")).drop("migrated_before")
    return rows, cold, known


class Dialect:
    """The few spellings in which the two SQL dialects differ."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def stamp(self, ts: str) -> str:
        if self.spark:
            return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')" if self.spark else f"strftime({ts}, '%Y-%m-%d')"

    def millis(self, ts: str) -> str:
        if self.spark:
            return f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"
        return f"(epoch_us({ts}) // 1000)"

    def text(self, value: str) -> str:
        return f"CAST({value} AS STRING)" if self.spark else f"CAST({value} AS VARCHAR)"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"


SPARK, DUCK = Dialect(True), Dialect(False)


def body_sql(d: Dialect) -> str:
    """Body of the request an event stands for: ten ways to ask for a time, six ways to sort."""
    end = "ts + INTERVAL '2' DAY"
    days = d.text("user_id % 30")
    number, next_number = d.text(d.millis("ts")), d.text(f"{d.millis('ts')} + 86400000")

    def at(bounds: str, field: str = "@timestamp") -> str:
        return f"""'{{"range":{{"{field}":{{' || {bounds} || '}}}}}}'"""

    query = f"""CASE event_id % 10
      WHEN 0 THEN '"query":{{"bool":{{"filter":[' || {at(f"'\"gte\":\"' || {d.stamp('ts')} || '\",\"lte\":\"' || {d.stamp(end)} || '\"'")} || ']}}}},'
      WHEN 1 THEN '"query":{{"bool":{{"must":' || {at(f"'\"gt\":\"' || {d.day('ts')} || '\"'")} || '}}}},'
      WHEN 2 THEN '"query":' || {at(f"'\"gte\":' || {number} || ',\"lt\":' || {next_number}")} || ','
      WHEN 3 THEN '"query":' || {at(f"'\"gte\":\"now-' || {days} || 'd\",\"lte\":\"now\"'")} || ','
      WHEN 4 THEN '"size":"5",'
      WHEN 5 THEN '"query":' || {at("'\"gte\":\"now-1d\"'", "created_at")} || ','
      WHEN 6 THEN '"query":{{"bool":['
      WHEN 7 THEN '"query":{{"bool":{{"filter":[{{"term":{{"event_type":"view"}}}},' || {at("'\"gte\":\"someday\"'")} || ',' || {at(f"'\"lt\":\"now-' || {days} || 'd||/d\"'")} || ']}}}},'
      WHEN 8 THEN '"query":' || {at(f"'\"gte\":\"' || {number} || '\",\"to\":\"' || {d.stamp('ts')} || '\"'")} || ','
      ELSE '"query":{{"bool":{{"should":[' || {at("'\"gte\":\"now-1d\"'")} || ']}}}},'
    END"""
    sort = """CASE user_id % 6
      WHEN 0 THEN ''
      WHEN 1 THEN '"sort":"_score",'
      WHEN 2 THEN '"sort":[{"_score":{"order":"asc"}}],'
      WHEN 3 THEN '"sort":[{"@timestamp":"desc"}],'
      WHEN 4 THEN '"sort":["_score",{"@timestamp":"asc"}],'
      ELSE CASE WHEN event_id % 4 = 0 THEN '"sort":{"_score":"desc"},"search_after":[1],' ELSE '"sort":{"_score":"desc"},' END
    END"""
    size = f"""CASE WHEN event_id % 10 = 4 THEN '' ELSE '"size":' || {d.text('event_id % 7')} || '.5,' END"""
    start = f"""'"from":' || {d.text('(user_id % 3) * 5')}"""
    return f"""'{{' || {query} || {sort} || {size} || {start} || '}}'"""


def indices_sql(d: Dialect) -> str:
    """Tables a request names: one, one twice over, a wildcard, or a wildcard and a name."""
    own = "\"index\"" if not d.spark else "`index`"
    return f"""CASE event_type
      WHEN 'click' THEN {d.array(own)}
      WHEN 'view' THEN {d.array("'events-2024.01.*'")}
      WHEN 'error' THEN {d.array(own, "'events-2024.01.15'")}
      ELSE {d.array("'events-*'", own)}
    END"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(req_id, indices, body)``, one request per event."""
    return spread(events(spark, sf_dir)).selectExpr(
        "event_id AS req_id", f"{indices_sql(SPARK)} AS indices", f"{body_sql(SPARK)} AS body"
    )


# What the time range of each body is, stated from how the body was made.
RANGE_FROM_SQL = """CASE event_id % 10
  WHEN 0 THEN date_trunc('second', ts)
  WHEN 1 THEN date_trunc('day', ts)
  WHEN 2 THEN date_trunc('millisecond', ts)
  WHEN 3 THEN TIMESTAMP '2024-01-31' - to_days(CAST(user_id % 30 AS INTEGER))
END"""
RANGE_TO_SQL = """CASE event_id % 10
  WHEN 0 THEN date_trunc('second', ts) + INTERVAL 2 DAY
  WHEN 2 THEN date_trunc('millisecond', ts) + INTERVAL 1 DAY
  WHEN 3 THEN TIMESTAMP '2024-01-31'
  WHEN 7 THEN TIMESTAMP '2024-01-31' - to_days(CAST(user_id % 30 AS INTEGER))
  WHEN 8 THEN date_trunc('second', ts)
END"""
RANGES_SQL = f"""(SELECT event_id AS req_id, event_id, user_id, event_type, "index", ts AS made_at,
  {RANGE_FROM_SQL} AS range_from, {RANGE_TO_SQL} AS range_to,
  (event_id % 10) = 1 AS from_open, (event_id % 10) IN (2, 7) AS to_open,
  (event_id % 10) IN (0, 1, 2, 3, 7, 8) AS has_range
  FROM {EVENTS_SQL})"""


def route_sql(cutoff: str = "TIMESTAMP '2024-01-21'") -> str:
    return f"""CASE WHEN range_from IS NULL AND range_to IS NULL THEN 'both'
      WHEN range_to < {cutoff} THEN 'cold_only'
      WHEN range_from >= {cutoff} THEN 'hot_only' ELSE 'both' END"""


def cold_scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") < ts_literal(RETENTION_CUTOFF))
