"""Many searches over both tiers in one job.

A search asks for the best rows of some tables within a time range. Joining every
search to every row of its range would cost searches x rows, so the rows are first
rolled up by hour, day and table: how many there are, and which are the best K in each
order asked for, K being the deepest page of the whole batch. Searches that cover the same
whole hours of the same tables share one answer, read from the roll-up of each whole table,
day and hour covered. Real rows are read only for the two broken hours at the ends of a search; where
many ends meet many rows, a task answers them from a tree over the rows (``msearch_ends``).
Hours that hold very many rows are rolled up by minute as
well, and such minutes by second, so a burst does not bring searches x rows back. The
answer is exact: a row outside the best K of a bucket cannot be on a page no deeper than
K that covers the bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bodies
from tidemark.functions.times import micros_of, ts_literal
from tidemark.operators.indices import expand_names
from tidemark.plans.msearch_ends import answer_ends, split_ends
from tidemark.sources.files import settled
from tidemark.sources.lines import msearch_entries

NOT_AN_OBJECT = "body is not a JSON object"
UNSUPPORTED_QUERY = "query is not a single range on the time field"
UNSUPPORTED_ORDER = "order is not one of the declared columns"
WHOLE_TABLE = "1970-01-01 00:00:00"  # bucket of the table level
MAX_LISTED_NAMES = 1000  # up to this many names are put into the scan as literals
DENSE_ROWS = 100_000  # a bucket with more rows is broken up further
HIT = ["sort_value", "tier", "index", "key", "ts", "score"]
RANK_BOUND = "spark.sql.optimizer.windowGroupLimitThreshold"


def plan_requests(requests: DataFrame, now: datetime, orders: Mapping[str, str], field: str = "@timestamp") -> DataFrame:
    """``(req_id, indices, start, end, from_, size, need, order_key, error)`` per request.

    ``start`` is inclusive and ``end`` exclusive, strict bounds moved by a microsecond. A query
    that is more than one range on ``field`` is refused, as its other clauses are not evaluated.
    """
    micro = F.expr("interval 1 microsecond")
    asked = (
        requests.withColumn("_parsed", bodies.parsed(F.col("body")))
        .withColumn("_range", bodies.time_range(F.col("_parsed"), F.lit(field), now))
        .withColumn("_paging", bodies.paging(F.col("_parsed")))
        .withColumn("_plain", bodies.is_plain_range(F.col("_parsed"), F.lit(field), now))
        .select("req_id", "indices", "_range.*", "_paging.*", "_plain")
    )
    known = F.col("sort_field").isin([*orders])
    error = (
        F.when(~F.col("paginate"), F.lit(NOT_AN_OBJECT))
        .when(F.col("reason").startswith("search_after") | F.col("reason").startswith("pit"), F.col("reason"))
        .when(~F.col("_plain"), F.lit(UNSUPPORTED_QUERY))
        .when(~F.coalesce(known, F.lit(False)), F.lit(UNSUPPORTED_ORDER))
    )
    return asked.select(
        "req_id",
        "indices",
        F.when(F.col("from_open"), F.col("range_from") + micro).otherwise(F.col("range_from")).alias("start"),
        F.when(F.col("to_open"), F.col("range_to")).otherwise(F.col("range_to") + micro).alias("end"),
        "from_",
        "size",
        "need",
        F.concat("sort_field", F.when(F.col("sort_asc"), F.lit(":asc")).otherwise(F.lit(":desc"))).alias("order_key"),
        error.alias("error"),
    )


def _sort_value(column: str, rows: DataFrame) -> Column:
    """Column as a number: microseconds of a time, a missing value as zero."""
    if dict(rows.dtypes)[column].startswith("timestamp"):
        return micros_of(F.col(column)).cast("double")
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def ordered_rows(rows: DataFrame, orders: Mapping[str, str], used: list[str], key: str, score: str) -> DataFrame:
    """Rows once per order in use, with a ``sort_value`` that rises in that order."""
    variants = []
    for order_key in used:
        name, direction = order_key.rsplit(":", 1)
        value = _sort_value(orders[name], rows)
        variants.append(
            F.struct(F.lit(order_key).alias("order_key"), (value if direction == "asc" else -value).alias("sort_value"))
        )
    return rows.select(
        "index",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        "ts",
        "tier",
        F.col(key).alias("key"),
        F.col(score).alias("score"),
        F.explode(F.array(*variants)).alias("_order"),
    ).select("*", "_order.*").drop("_order")


def bound_ranks(spark: SparkSession, depth: int) -> None:
    """Have Spark drop rows beyond a rank before the shuffle for ranks up to ``depth``; by itself it does so below 1,000 only."""
    spark.conf.set(RANK_BOUND, str(max(depth + 1, int(spark.conf.get(RANK_BOUND)))))


def _best(rows: DataFrame, by: list[str], depth: int) -> DataFrame:
    """The first ``depth`` rows per group with their ``place``; each task drops the rest of its own rows before the shuffle."""
    ranked = rows.selectExpr(
        "*",
        f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY sort_value, "
        "CASE WHEN tier = 'hot' THEN 0 ELSE 1 END, index, key) AS _place",
    )
    return ranked.where(F.col("_place") <= depth).drop("place").withColumnRenamed("_place", "place")


def best_by_bucket(ordered: DataFrame, depth: int) -> DataFrame:
    """Best rows per table, day and hour, each level made from the one below it."""
    hours = settled(_best(ordered, ["index", "hour", "order_key"], depth), "best-hours")
    in_day = hours.withColumn("day", F.date_trunc("day", "hour").cast("timestamp_ntz"))
    days = settled(_best(in_day, ["index", "day", "order_key"], depth).drop("hour"), "best-days")
    tables = _best(days, ["index", "order_key"], depth)

    def level(rows: DataFrame, name: str, bucket: Column) -> DataFrame:
        columns = [c for c in HIT if c != "index"]
        return rows.select("index", F.lit(name).alias("level"), bucket.alias("bucket"), "order_key", "place", *columns)

    return (
        level(hours, "hour", F.col("hour"))
        .union(level(days, "day", F.col("day")))
        .union(level(tables, "table", ts_literal(WHOLE_TABLE)))
    )


def counts_by_bucket(hourly: DataFrame) -> DataFrame:
    """Rows per table, day and hour."""
    sizes = F.sum("n").alias("n")
    day = F.date_trunc("day", "hour").cast("timestamp_ntz").alias("bucket")
    hours = hourly.select("index", F.lit("hour").alias("level"), F.col("hour").alias("bucket"), "n")
    days = hourly.groupBy("index", day).agg(sizes).select("index", F.lit("day").alias("level"), "bucket", "n")
    tables = hourly.groupBy("index").agg(sizes).select(
        "index", F.lit("table").alias("level"), ts_literal(WHOLE_TABLE).alias("bucket"), "n"
    )
    return hours.union(days).union(tables)


def _floor(unit: str, at: str) -> str:
    return f"CAST(date_trunc('{unit}', {at}) AS TIMESTAMP_NTZ)"


def _ceil(unit: str, at: str) -> str:
    return f"({_floor(unit, f'({at} - interval 1 microsecond)')} + interval 1 {unit})"


def _nodes(level: str, start: str, end: str) -> str:
    """Whole buckets of a level in ``start .. end``, as an array of structs."""
    return (
        f"CASE WHEN {start} < {end} THEN transform(sequence({start}, {end} - interval 1 {level}, interval 1 {level}), "
        f"b -> named_struct('level', '{level}', 'bucket', b)) "
        "ELSE CAST(array() AS ARRAY<STRUCT<level: STRING, bucket: TIMESTAMP_NTZ>>) END"
    )


def _edges(first: str, last: str) -> str:
    """What whole buckets from ``first`` to ``last`` leave of ``lo .. hi``: one or two broken ends."""
    return (
        f"CASE WHEN {first} > {last} THEN array(named_struct('lo', lo, 'hi', hi)) ELSE filter(array("
        f"named_struct('lo', lo, 'hi', {first}), named_struct('lo', {last}, 'hi', hi)), e -> e.lo < e.hi) END"
    )


def clipped(targets: DataFrame) -> DataFrame:
    """``(start, end, first_ts, last_ts, ...)`` that overlap, with their range ``lo .. hi`` and whether it is ``whole``."""
    overlapping = targets.where(
        (F.col("start").isNull() | (F.col("start") <= F.col("last_ts")))
        & (F.col("end").isNull() | (F.col("end") > F.col("first_ts")))
    )
    # An end beyond the rows of the table is moved out to midnight, where it breaks no hour.
    return overlapping.selectExpr(
        "*",
        "(start IS NULL OR start <= first_ts) AND (end IS NULL OR end > last_ts) AS whole",
        f"CASE WHEN start > first_ts THEN start ELSE {_floor('day', 'first_ts')} END AS lo",
        f"CASE WHEN end <= last_ts THEN end ELSE {_floor('day', 'last_ts')} + interval 1 day END AS hi",
    ).where("lo < hi")


def cover(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(req_id, index, start, end, first_ts, last_ts, ...)`` into whole buckets and broken hours.

    Returns ``nodes`` with ``(level, bucket)`` and ``edges`` with ``(bucket, lo, hi)``.
    """
    cut = clipped(targets).selectExpr(
        "*",
        f"{_ceil('hour', 'lo')} AS h0",
        f"{_floor('hour', 'hi')} AS h1",
        f"{_ceil('day', 'lo')} AS d0",
        f"{_floor('day', 'hi')} AS d1",
    )
    table_node = f"array(named_struct('level', 'table', 'bucket', TIMESTAMP_NTZ'{WHOLE_TABLE}'))"
    pieces = (
        f"concat({_nodes('day', 'd0', 'd1')}, CASE WHEN d0 <= d1 THEN concat({_nodes('hour', 'h0', 'd0')}, "
        f"{_nodes('hour', 'd1', 'h1')}) ELSE {_nodes('hour', 'h0', 'h1')} END)"
    )
    kept = [c for c in targets.columns if c not in ("start", "end", "first_ts", "last_ts")]
    nodes = cut.selectExpr(*kept, f"inline(CASE WHEN whole THEN {table_node} ELSE {pieces} END)")
    edges = cut.where("NOT whole").selectExpr(*kept, f"inline({_edges('h0', 'h1')})")
    return nodes, edges.selectExpr("*", f"{_floor('hour', 'lo')} AS bucket")


def refine(edges: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Split broken ends into whole buckets of a smaller unit and smaller broken ends."""
    kept = [c for c in edges.columns if c not in ("bucket", "lo", "hi")]
    cut = edges.selectExpr("*", f"{_ceil(unit, 'lo')} AS u0", f"{_floor(unit, 'hi')} AS u1")
    nodes = cut.selectExpr(*kept, f"inline({_nodes(unit, 'u0', 'u1')})")
    ends = cut.selectExpr(*kept, f"inline({_edges('u0', 'u1')})")
    return nodes, ends.selectExpr("*", f"{_floor(unit, 'lo')} AS bucket")


def _in_bucket(rows: DataFrame, unit: str) -> DataFrame:
    return rows.withColumn("bucket", F.date_trunc(unit, "ts").cast("timestamp_ntz"))


def _asked_for(rows: DataFrame, names: DataFrame, first: datetime | None, last: datetime | None) -> DataFrame:
    """Rows of the tables and within the times that any search asks for."""
    listed = [r["index"] for r in names.limit(MAX_LISTED_NAMES + 1).collect()]
    rows = rows.where(F.col("index").isin(listed)) if len(listed) <= MAX_LISTED_NAMES else rows.join(names, "index", "left_semi")
    if first is not None:
        rows = rows.where(F.col("ts") >= ts_literal(first))
    return rows if last is None else rows.where(F.col("ts") < ts_literal(last))


def scoped(wanted: DataFrame, named: DataFrame, extents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scope of each list of patterns ``(patterns, scope)``, the tables of each ``(scope, index)`` and what times they hold.

    Lists that lead to the same tables are one scope; one that leads to none has no row.
    """
    tables = wanted.join(named, "pattern").join(extents.select("index"), "index").groupBy("patterns").agg(
        F.array_sort(F.collect_set("index")).alias("tables")
    )
    tables = settled(tables, "tables")
    scopes = settled(tables.select("tables").distinct().withColumn("scope", F.monotonically_increasing_id()), "scopes")
    members = scopes.select("scope", F.explode("tables").alias("index"))
    spans = members.join(extents, "index").groupBy("scope").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return tables.join(scopes, "tables").drop("tables"), members, settled(spans, "spans")


def answer(
    requests: DataFrame,
    rows: DataFrame,
    now: datetime,
    orders: Mapping[str, str] | None = None,
    field: str = "@timestamp",
    key: str = "event_id",
    score: str = "score",
    dense_rows: int = DENSE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Answer every request ``(req_id, indices, body)`` over ``rows`` (see ``union_exact``).

    Returns page rows ``(req_id, rank, index, key, ts, tier, score)`` and one summary row
    per request ``(req_id, status, error, total, relation, max_score)``.
    """
    spark = requests.sparkSession
    orders = dict(orders or {"_score": score})
    planned = settled(plan_requests(requests, now, orders, field), "requests")
    # Rows that repeat a req_id ask for the tables of all of them.
    same = Window.partitionBy("req_id")
    patterns = F.array_sort(F.array_distinct(F.flatten(F.collect_list("indices").over(same))))
    valid = settled(planned.where("error IS NULL AND req_id IS NOT NULL").withColumn("patterns", patterns).drop("indices", "error"), "valid")
    asked = valid.agg(
        F.max("need").alias("depth"),
        F.collect_set("order_key").alias("used"),
        F.when(F.count_if(F.col("start").isNull()) == 0, F.min("start")).alias("first"),
        F.when(F.count_if(F.col("end").isNull()) == 0, F.max("end")).alias("last"),
    ).first()
    depth, used = asked["depth"] or 0, sorted(asked["used"]) or ["_score:desc"]
    bound_ranks(spark, depth)

    slim = rows.select("index", "ts", "tier", F.col(key), *{c for c in [score, *orders.values()] if c != "ts"})
    lists = settled(valid.select("patterns").distinct(), "lists")
    wanted = lists.select("patterns", F.explode("patterns").alias("pattern"))
    named = settled(expand_names(wanted, settled(slim.select("index").distinct(), "catalog")), "names")
    slim = _asked_for(slim, named.select("index").distinct(), asked["first"], asked["last"])
    hourly = settled(
        slim.groupBy("index", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
        ),
        "hourly",
    )
    extents = hourly.groupBy("index").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    ordered = ordered_rows(slim, orders, used, key, score)
    best, counts = best_by_bucket(ordered, depth), counts_by_bucket(hourly)

    # Searches of the same tables are one scope, and those of the same whole hours of it share their answer for these.
    tables, members, spans = scoped(wanted, named, extents)
    targets = clipped(
        valid.join(tables, "patterns").drop("patterns").join(spans, "scope")
    ).selectExpr("*", f"{_ceil('hour', 'lo')} AS h0", f"{_floor('hour', 'hi')} AS h1")
    shared = ["scope", "order_key", "first", "last"]
    targets = settled(
        targets.selectExpr(
            "req_id", "scope", "from_", "size", "need", "order_key", "whole", "lo", "hi", "h0", "h1",
            f"CASE WHEN whole THEN TIMESTAMP_NTZ'{WHOLE_TABLE}' WHEN h0 < h1 THEN h0 END AS first",
            f"CASE WHEN whole THEN TIMESTAMP_NTZ'{WHOLE_TABLE}' WHEN h0 < h1 THEN h1 END AS last",
        ),
        "targets",
    )
    spans = targets.where("first IS NOT NULL").groupBy(*shared).agg(F.max("need").alias("need"))
    spans = settled(spans.withColumn("span", F.monotonically_increasing_id()), "shared")
    within = spans.join(members, "scope").join(extents, "index").selectExpr(
        "span", "index", "need", "order_key", "first_ts", "last_ts",
        "CASE WHEN first < last THEN first END AS start", "CASE WHEN first < last THEN last END AS end",
    )
    # Every pair fans out below, so they are dealt out by number, not by size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, _ = cover(settled(within.repartition(tasks, "span", "index"), "within"))
    middle = nodes.where("need > 0").join(best, ["index", "level", "bucket", "order_key"]).where(F.col("place") <= F.col("need"))
    middle = settled(_best(middle.select("span", "need", "place", *HIT), ["span"], depth).where("place <= need").drop("need"), "middle")
    held = settled(nodes.join(counts, ["index", "level", "bucket"]).groupBy("span").agg(F.sum("n").alias("n")), "held")
    targets = targets.join(spans.drop("need"), shared, "left").drop("first", "last")

    # Broken ends with the rows they are compared with, dense buckets broken up further.
    last_hits = middle.select("span", F.col("place").cast("long").alias("need"), F.col("sort_value").alias("most"))
    edges = targets.where("NOT whole").withColumn("need", F.col("need").cast("long")).join(last_hits, ["span", "need"], "left").selectExpr(
        "req_id", "scope", "from_", "size", "need", "order_key", "most", f"inline({_edges('h0', 'h1')})"
    )
    hours = members.join(hourly, "index").select("scope", "index", F.col("hour").alias("bucket"))
    edges = edges.selectExpr("*", f"{_floor('hour', 'lo')} AS bucket").join(hours, ["scope", "bucket"]).drop("scope")
    edges = settled(edges, "edges")
    values = {o: F.col(f"by_{i}") for i, o in enumerate(used)}
    rows_in, plain = ordered, slim.select(
        "index", "ts", "tier", F.col(key).alias("key"), F.col(score).alias("score"),
        *[(v if o.endswith(":asc") else -v).alias(f"by_{i}") for i, o in enumerate(used) for v in [_sort_value(orders[o.rsplit(":", 1)[0]], slim)]],
    )
    ends, finer_hits, finer_facts = [], [], []
    sizes = hourly.select("index", F.col("hour").alias("bucket"), "n")
    dense = sizes.where(F.col("n") > dense_rows).select("index", "bucket")
    unit, inside = "hour", ["index", "bucket"]
    for smaller in ("minute", "second"):
        if dense.isEmpty():
            break
        ends.append((edges.join(dense, inside, "left_anti"), plain, sizes, unit))
        edges = edges.join(dense, inside, "left_semi")
        rows_in = _in_bucket(rows_in, unit).join(dense, inside, "left_semi").drop("bucket")
        plain = _in_bucket(plain, unit).join(dense, inside, "left_semi").drop("bucket")
        finer_nodes, edges = refine(edges, smaller)
        finer = settled(_best(_in_bucket(rows_in, smaller), ["index", "bucket", "order_key"], depth), f"best-{smaller}")
        sizes = settled(_in_bucket(plain, smaller).groupBy("index", "bucket").agg(F.count(F.lit(1)).alias("n")), f"counts-{smaller}")
        finer_hits.append(finer_nodes.where("need > 0").join(finer, ["index", "bucket", "order_key"]).where(F.col("place") <= F.col("need")))
        finer_facts.append(finer_nodes.join(sizes, inside))
        dense = sizes.where(F.col("n") > dense_rows).select("index", "bucket")
        unit = smaller
    ends.append((edges, plain, sizes, unit))

    paging = ["req_id", "from_", "need"]
    hits = targets.where("need > 0").join(middle, "span").where(F.col("place") <= F.col("need")).select(*paging, *HIT)
    facts = targets.join(held, "span").select("req_id", "n")
    for found in finer_hits:
        hits = hits.union(found.select(*paging, *HIT))
    for found in finer_facts:
        facts = facts.union(found.select("req_id", "n"))
    for broken, rows_of, known, at in ends:
        few, many = split_ends(broken, known, dense_rows)
        near = few.join(_in_bucket(rows_of, at), inside).where("ts >= lo AND ts < hi")
        facts = facts.union(near.select("req_id", F.lit(1).cast("bigint")))
        near = near.where("need > 0").withColumn("sort_value", F.coalesce(*[F.when(F.col("order_key") == o, v) for o, v in values.items()]))
        hits = hits.union(near.where("most IS NULL OR sort_value <= most").select(*paging, *HIT))
        found = settled(answer_ends(many, _in_bucket(rows_of, at), values, HIT[1:]), "ends")
        facts = facts.union(found.select("req_id", "n"))
        hits = hits.union(found.select(*paging, F.inline("hits")))
    ranked = hits.selectExpr(
        "*",
        "row_number() OVER (PARTITION BY req_id ORDER BY sort_value, "
        "CASE WHEN tier = 'hot' THEN 0 ELSE 1 END, index, key) AS position",
    )
    in_page = (F.col("position") > F.col("from_")) & (F.col("position") <= F.col("need"))
    page = (
        ranked.where((F.col("position") <= depth) & in_page)
        .withColumn("rank", F.col("position") - F.col("from_"))
        .select("req_id", "rank", "index", "key", "ts", "tier", "score")
    )

    no_score = F.lit(None).cast("double").alias("score")
    facts = (
        facts.select("req_id", "n", no_score)
        .union(page.select("req_id", F.lit(0).cast("bigint"), F.coalesce("score", F.lit(0.0))))
        .groupBy("req_id")
        .agg(F.sum("n").alias("total"), F.max("score").alias("max_score"))
    )
    good = F.col("error").isNull()
    summary = planned.select("req_id", "error").join(facts, "req_id", "left").select(
        "req_id",
        F.when(good, F.lit(200)).otherwise(F.lit(400)).alias("status"),
        "error",
        F.when(good, F.coalesce("total", F.lit(0))).alias("total"),
        F.when(good, F.lit("eq")).alias("relation"),
        "max_score",
    )
    return page, summary


def answer_files(
    lines: DataFrame, rows: DataFrame, now: datetime, default_indices: Sequence[str] = (), **options: object
) -> DataFrame:
    """Responses to multi-search files (``read_lines``), one row per entry, to be read in order of ``(file, entry)``.

    Columns ``(file, entry, status, error, total, relation, max_score, hits)``, ``hits`` being the page as an array of
    ``(rank, index, key, ts, tier, score)``. A file rejected as a whole is one row without ``entry``. A file with an entry that
    names no table or an internal one is answered from hot alone; such an entry asks for just the tables it names.
    """
    entries, report = msearch_entries(lines, default_indices)
    report = settled(report, "files")
    good = entries.join(report.where("error IS NULL").select("file", "passthrough"), "file")
    asked = settled(
        good.select(F.struct("file", "entry").alias("req_id"), "passthrough", "indices", "body"), "entries"
    )
    answers = [answer(asked.where("NOT passthrough").drop("passthrough"), rows, now, **options)]
    if not report.where("passthrough").isEmpty():
        answers.append(answer(asked.where("passthrough").drop("passthrough"), rows.where("tier = 'hot'"), now, **options))
    responses = []
    for page, summary in answers:
        hit = F.struct(*[c for c in page.columns if c != "req_id"])
        pages = page.groupBy("req_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
        responses.append(summary.join(pages, "req_id", "left").select("req_id.*", *[c for c in summary.columns if c != "req_id"], "hits"))
    none = {c: F.lit(None).cast(responses[0].schema[c].dataType).alias(c) for c in responses[0].columns}
    rejected = report.where("error IS NOT NULL").select(
        *["file" if c == "file" else "error" if c == "error" else F.lit(400).alias(c) if c == "status" else none[c] for c in none]
    )
    for more in (*responses[1:], rejected):
        responses[0] = responses[0].unionByName(more)
    return responses[0]
