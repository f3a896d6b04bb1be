"""What requests ask for, and multi-search files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bodies
from tidemark.operators.indices import expand_names, resolve
from tidemark.operators.requests import with_outcome, with_paging, with_route, with_time_range
from tidemark.sources.lines import EMPTY, LONG_LINE, ODD_LINES, msearch_entries, read_lines

NOW = datetime(2025, 7, 1)
D = datetime


def ranged(clause, place="filter"):
    return '{"query":{"bool":{"%s":%s}}}' % (place, clause)


RANGES = {
    ranged('{"range":{"@timestamp":{"gt":"2023-11-05T06:07:08.5Z","lt":"2023-11-05T09:00:00+01:00"}}}', "must"): (D(2023, 11, 5, 6, 7, 8, 500000), D(2023, 11, 5, 8)),
    ranged('[{"exists":{"field":"u"}},{"range":{"@timestamp":{"lte":"2022-02-28"}}}]'): (None, D(2022, 2, 28)),
    ranged('{"range":{"@timestamp":{"gt":"2025-06-01"}}}'): (D(2025, 6, 1), None),
    '{"query":{"range":{"@timestamp":{"lt":951782400000,"boost":1}}}}': (None, D(2000, 2, 29)),
    '{"query":{"range":{"@timestamp":{"gte":"now-7d","lte":"now"}}}}': (D(2025, 6, 24), NOW),
    '{"query":{"range":{"@timestamp":{"gte":"junk","from":"2025-01-01","to":"2025-02-01"}}}}': (D(2025, 1, 1), D(2025, 2, 1)),
    # the first clause that yields a bound wins, filter before must
    ranged('[{"range":{"@timestamp":{"gte":"junk"}}},{"range":{"@timestamp":{"lt":"2025-03-01"}}},{"range":{"@timestamp":{"lt":"2025-04-01"}}}]'): (None, D(2025, 3, 1)),
    '{"query":{"range":{"@timestamp":{"gte":"junk"}},"bool":{"must":[{"range":{"@timestamp":{"gte":"2025-01-02"}}}],"filter":{"range":{"x":{"gte":"2025-01-01"}}}}}}': (D(2025, 1, 2), None),
    ranged('[{"range":{"@timestamp":{"gte":"2025-01-01"}}}]', "should"): (None, None),
    ranged('[{"bool":{"filter":[{"range":{"@timestamp":{"gte":"2025-01-01"}}}]}}]'): (None, None),
    '{"query":{"range":{"other":{"gte":"2025-01-01"}}}}': (None, None),
    '{"size":1}': (None, None),
    "not json": (None, None),
    "[]": (None, None),
    "null": (None, None),
    '{"query":"x"}': (None, None),
}


def test_time_ranges(spark):
    df = spark.createDataFrame([(b,) for b in RANGES], "body STRING")
    rows = with_time_range(df, NOW).collect()
    assert {r.body: (r.range_from, r.range_to) for r in rows} == RANGES


def test_field_per_request(spark):
    body = '{"query":{"range":{"created_at":{"gte":"2025-01-01"},"@timestamp":{"gte":"2025-02-01"}}}}'
    df = spark.createDataFrame([("created_at", body), ("@timestamp", body)], "f STRING, body STRING")
    got = [r.range_from for r in with_time_range(df, NOW, F.col("f")).orderBy("f").collect()]
    assert got == [D(2025, 2, 1), D(2025, 1, 1)]


ROUTES = [
    ("2025-06-20", "2025-06-25T12:00:00Z", bodies.HOT),
    ("2020-01-01", "2025-05-31", bodies.COLD),
    ("2025-05-31T23:00:00Z", "2025-06-02", bodies.BOTH),
    ("2025-06-01", None, bodies.HOT),  # from the cutoff on is hot
    ("now-719h", None, bodies.HOT),
    ("now-721h", None, bodies.BOTH),
    ("now-721h", "now-720h", bodies.BOTH),
    (None, "now-5w", bodies.COLD),
    (None, "2025-06-01", bodies.BOTH),
    (None, None, bodies.BOTH),
]


def test_routes(spark):
    rows = []
    for i, (lower, upper, _) in enumerate(ROUTES):
        bounds = ",".join(f'"{k}":"{v}"' for k, v in (("gte", lower), ("lte", upper)) if v)
        rows.append((i, '{"query":{"range":{"@timestamp":{%s}}}}' % bounds))
    got = with_route(spark.createDataFrame(rows, "i INT, body STRING"), NOW, 30).orderBy("i").collect()
    assert [r.route for r in got] == [route for _, _, route in ROUTES]


def test_routes_over_several_tables(spark):
    body = '{"query":{"range":{"@timestamp":{"lte":"now-90d"}}}}'
    rows = [(0, ["a"], body), (1, ["a", "b"], body), (2, ["a", "e"], body), (3, [], body)]
    df = spark.createDataFrame(rows, "i INT, indices ARRAY<STRING>, body STRING")
    got = with_route(df, NOW, 30, {"e": "created_at"}, indices="indices").orderBy("i").collect()
    assert [r.route for r in got] == ["cold_only", "cold_only", "both", "both"]


PAGING = {
    "{}": (0, 10, 10, False, True, True),
    '{"from":20,"size":5}': (20, 5, 25, False, True, True),
    '{"from":-3,"size":-1}': (0, 0, 0, False, True, True),
    '{"from":"2","size":7.9}': (0, 7, 7, False, True, True),
    '{"sort":null}': (0, 10, 10, False, True, True),
    '{"sort":"_score"}': (0, 10, 10, False, True, True),
    '{"sort":[]}': (0, 10, 10, False, True, True),
    '{"sort":["_score"]}': (0, 10, 10, False, True, True),
    '{"sort":{"_score":"asc"}}': (0, 10, 10, True, True, True),
    '{"sort":[{"_score":{"order":"asc"}}]}': (0, 10, 10, True, True, True),
    '{"sort":{"_score":7}}': (0, 10, 10, False, True, True),
    '{"sort":[{"ts":"desc"}]}': (0, 10, 10, False, True, False),
    '{"sort":"ts"}': (0, 10, 10, True, True, False),
    '{"sort":["_score","ts"]}': (0, 10, 10, None, True, False),
    '{"sort":{"_score":"asc","ts":"asc"}}': (0, 10, 10, None, True, False),
    '{"sort":[[[[["_score"]]]]]}': (0, 10, 10, False, True, True),
    '{"sort":[[[[[[]]]]]]}': (0, 10, 10, False, True, True),
    '{"sort":[[[[[{"_score":"asc"}]]]]]}': (0, 10, 10, True, True, True),
    '{"sort":[["_score"],["ts"]]}': (0, 10, 10, None, True, False),
    '{"sort":[[],[]]}': (0, 10, 10, None, True, False),
    '{"sort":[[],"_score"]}': (0, 10, 10, None, True, False),
    '{"sort":[["_score","ts"]]}': (0, 10, 10, None, True, False),
    '{"sort":["a]"]}': (0, 10, 10, True, True, False),
    '{"sort":3}': (0, 10, 10, None, True, False),
    '{"search_after":null}': (0, 10, 10, False, True, False),
    '{"pit":{"id":"x"}}': (0, 10, 10, False, True, False),
    "not json": (0, 10, None, False, False, True),
}


def test_paging(spark):
    df = spark.createDataFrame([(b,) for b in PAGING], "body STRING")
    got = {r.body: (r.from_, r.size, r.need, r.sort_asc, r.paginate, r.mergeable) for r in with_paging(df).collect()}
    assert got == PAGING


def test_outcomes(spark):
    rows = [
        ("both", True, ["a"], "search", "merged"),
        ("both", False, ["a"], "search", "hot_results_only"),
        ("both", False, ["a"], "msearch", "error_400"),
        ("cold_only", False, ["a", "b"], "search", "error_400"),
        ("cold_only", False, ["a*"], "search", "error_400"),
        ("cold_only", False, ["a*"], "msearch", "single_tier"),
        ("cold_only", False, ["a"], "search", "single_tier"),
        ("hot_only", False, ["a", "b"], "search", "single_tier"),
    ]
    df = spark.createDataFrame(rows, "route STRING, mergeable BOOLEAN, indices ARRAY<STRING>, endpoint STRING, expected STRING")
    assert with_outcome(df).where("outcome <> expected").collect() == []


def test_resolve_keeps_order_and_plain_names(spark):
    catalog = spark.createDataFrame([("logs-1",), ("logs-2",), ("events-1",)], "index STRING")
    got = {r["index"]: r.position for r in resolve(catalog, ["logs-2", "logs-*", "gone", "[", "logs-2"]).collect()}
    assert got == {"logs-2": 0, "logs-1": 1, "gone": 2}


def test_expand_names_without_a_cross_join(spark):
    catalog = spark.createDataFrame([("logs-1",), ("logs-2",), ("log",), ("events-1",)], "index STRING")
    wanted = spark.createDataFrame([("logs-*",), ("*-1",), ("gone",), ("lo[g]",), ("[",)], "pattern STRING")
    expanded = expand_names(wanted, catalog)
    got = {(r.pattern, r["index"]) for r in expanded.collect()}
    assert got == {
        ("logs-*", "logs-1"), ("logs-*", "logs-2"), ("*-1", "logs-1"), ("*-1", "events-1"), ("gone", "gone"), ("lo[g]", "log"),
    }
    plan = expanded._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_msearch_file(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{}\n{"q":1}\n\n  \n{"index":"x, y"}\n{"q":2}\n')
    (tmp_path / "odd.ndjson").write_text('{}\n{"q":1}\n{}\n')
    (tmp_path / "blank.ndjson").write_text("\n  \n")
    (tmp_path / "dot.ndjson").write_text('{"index":".internal"}\n{"q":3}\n{"index":["z"]}\n{"q":4}\n')
    entries, files = msearch_entries(read_lines(spark, str(tmp_path)), ["logs"])
    got = {(r.file.rsplit("/", 1)[1], r.entry): (r.indices, r.body) for r in entries.collect()}
    assert got == {
        ("a.ndjson", 0): (["logs"], '{"q":1}'),
        ("a.ndjson", 1): (["x", "y"], '{"q":2}'),
        ("dot.ndjson", 0): ([".internal"], '{"q":3}'),
        ("dot.ndjson", 1): (["logs"], '{"q":4}'),
    }
    report = {r.file.rsplit("/", 1)[1]: (r.entries, r.error, r.passthrough) for r in files.collect()}
    assert report == {"a.ndjson": (2, None, False), "odd.ndjson": (0, ODD_LINES, False), "dot.ndjson": (2, None, True), "blank.ndjson": (0, EMPTY, False)}


@pytest.mark.parametrize("split", ["40", "1000000"])
def test_msearch_files_in_pieces(spark, tmp_path, split):
    """Files read in many small splits give the same pairs."""
    lines = [line for i in range(200) for line in ('{"index":"t%d"}' % i, "" if i % 3 else " ", '{"n":%d}' % i)]
    (tmp_path / "big.ndjson").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = msearch_entries(read_lines(spark, str(tmp_path)))[0].orderBy("entry").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.indices, r.body) for r in rows] == [([f"t{i}"], '{"n":%d}' % i) for i in range(200)]


def test_long_line_rejects_the_file_only_under_a_limit(spark):
    lines = spark.sql("SELECT 'f' AS file, 0 AS chunk, id AS position, if(id = 0, '{}', repeat('x', CAST(10485759 + id AS INT))) AS text FROM range(2)")
    _, files = msearch_entries(lines, ["logs"], max_line_bytes=10485760)
    assert files.first().error == LONG_LINE
    entries, files = msearch_entries(lines, ["logs"])
    assert files.first().error is None and entries.selectExpr("length(body) AS n").first().n == 10485760
