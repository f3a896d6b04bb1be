"""Times, names and documents."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, times
from tidemark.functions.documents import merge_agg_json, source_or_null, unwrap_source, unwrap_source_lenient

NOW = datetime(2024, 3, 31, 10, 11, 12, 123456)

TEXTS = {
    "now": NOW,
    "now-7d": datetime(2024, 3, 24, 10, 11, 12, 123456),
    "now-1d||/d": datetime(2024, 3, 30, 10, 11, 12, 123456),
    "now+90m": datetime(2024, 3, 31, 11, 41, 12, 123456),
    "now-2w": datetime(2024, 3, 17, 10, 11, 12, 123456),
    "now-1M": datetime(2024, 3, 2, 10, 11, 12, 123456),  # runs past the end of February
    "now+1y": datetime(2025, 3, 31, 10, 11, 12, 123456),
    "now/d": None,
    "now-1d-1d": None,
    "now\n": None,
    "now-99999999999999999999s": None,
    "2025-01-15": datetime(2025, 1, 15),
    "2025-02-30": None,
    "2025-01-15T01:02:03": datetime(2025, 1, 15, 1, 2, 3),
    "2025-01-15T01:02:03.25Z": datetime(2025, 1, 15, 1, 2, 3, 250000),
    "2025-01-15T01:02:03+02:30": datetime(2025, 1, 14, 22, 32, 3),
    "2025-01-15T24:02:03Z": None,
    "2025": None,
    "2025-1-5": None,
    "1736899200000": None,
    "": None,
}


def test_time_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    got = {r.t: r.at for r in df.select("t", times.time_text(F.col("t"), times.ts_literal(NOW)).alias("at")).collect()}
    assert got == TEXTS


def test_zone_of_the_session_does_not_matter(spark):
    df = spark.createDataFrame([("2025-01-15T01:02:03Z",), ("2025-07-15",), ("now-1h",)], "t STRING")
    value = times.time_text(F.col("t"), times.ts_literal(NOW))
    expected = [r.at for r in df.select(value.alias("at")).collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r.at for r in df.select(value.alias("at")).collect()] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_month_steps_run_over(spark):
    df = spark.createDataFrame([("2024-03-31 01:00:00", -1), ("2024-02-29 01:00:00", 12), ("2024-01-31 01:00:00", 1)], "t STRING, n INT")
    got = [r.x for r in df.select(times.add_months_overflowing(F.col("t").cast("timestamp_ntz"), F.col("n")).alias("x")).collect()]
    assert got == [datetime(2024, 3, 2, 1), datetime(2025, 3, 1, 1), datetime(2024, 3, 2, 1)]


def test_numbers_are_milliseconds_and_text_of_digits_is_no_time(spark):
    df = spark.createDataFrame([("1736899200000",), ("1736899200000.9",), ('"1736899200000"',), ("true",), ("null",), ("[1]",), ("1e300",)], "v STRING")
    got = [r.at for r in df.select(times.time_value(F.parse_json("v"), times.ts_literal(NOW)).alias("at")).collect()]
    assert got[:6] == [datetime(2025, 1, 15), datetime(2025, 1, 15), None, None, None, None]
    assert got[6].year == 9999


WILDCARDS = {
    "logs-*": {"logs-1", "logs-"},
    "a?c": {"abc"},
    "[a-c]x": {"bx"},
    "[^a-c]x": {"dx", "]x", "/x"},
    "[z-a]x": set(),
    "[^z-a]x": {"bx", "dx", "]x", "/x"},
    "a\\*b": {"a*b"},
    "[\\]]x": {"]x"},
    "é*": {"éa"},
    "[a": set(),
    "[]a]x": set(),
    "[-a]x": set(),
    "abc\\": set(),
    "abc": {"abc"},
    "a.c": set(),
}
NAMES = ["logs-1", "logs-", "logs/1", "abc", "a/c", "bx", "dx", "]x", "/x", "a*b", "axb", "éa"]


def test_wildcards_as_literals_and_as_data(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n STRING")
    for pattern, expected in WILDCARDS.items():
        literal = {r.n for r in df.where(names.matches_wildcard(F.col("n"), pattern)).collect()}
        as_data = names.wildcard_regex_column(F.lit(pattern) if pattern else F.lit(""))
        column = {r.n for r in df.where(F.rlike("n", as_data)).collect()}
        assert (literal, column) == (expected, expected), pattern


def test_index_dates(spark):
    cases = {
        "web-eu-2023.07.19": datetime(2023, 7, 19).date(),
        "audit-2022-11-30": datetime(2022, 11, 30).date(),
        "a-b-2024.02.29": datetime(2024, 2, 29).date(),
        "jobs-2023.02.29": None,
        "jobs-2023.13.01": None,
        "jobs-2023.05.06-old": None,
        "jobs-20230506": None,
        "jobs": None,
        "": None,
    }
    df = spark.createDataFrame([(n,) for n in cases], "n STRING")
    assert {r.n: r.d for r in df.select("n", names.index_date(F.col("n")).alias("d")).collect()} == cases


def test_only_old_names_are_ripe(spark):
    df = spark.createDataFrame([("jobs-2023.05.10",), ("jobs-2023.05.01",), ("jobs-2023.04.30",), ("jobs",)], "n STRING")
    kept = {r.n for r in df.where(names.ripe_name(F.col("n"), datetime(2023, 5, 10, 12), 9)).collect()}
    assert kept == {"jobs-2023.04.30", "jobs"}


def test_names_are_selected(spark):
    df = spark.createDataFrame([(n,) for n in ["logs-1", "logs-2", ".kibana", "top_queries-1", "security-auditlog-1", "x"]], "n STRING")

    def chosen(patterns, **options):
        return {r.n for r in df.where(names.select_names(F.col("n"), patterns, **options)).collect()}

    assert chosen(["logs-*"]) == {"logs-1", "logs-2"}
    assert chosen(["*"], hide_system=True) == {"logs-1", "logs-2", "x"}
    assert chosen([".kibana"], hide_system=True) == {".kibana"}
    assert chosen([" logs-1 ", "", "x"]) == {"logs-1", "x"}
    assert chosen([]) == set()
    assert names.split_names(" a, ,b ") == ["a", "b"]


def test_cold_days(spark):
    rules = {"bills": 3000, "bill-*": 700, "b*": 21}
    df = spark.createDataFrame([("bills",), ("bill-7",), ("bolt",), ("zeta",)], "n STRING")
    got = [r.d for r in df.select(names.cold_days(F.col("n"), rules, 90).alias("d")).collect()]
    assert got == [3000, 700, 21, 90]
    assert [r.d for r in df.select(names.cold_days(F.col("n"), {}, 0).alias("d")).collect()] == [0, 0, 0, 0]


def test_unwrap(spark):
    hits = {
        '{"_index":"a","_id":"1","_score":1,"_source":{"b":"x","a":[1,2]}}': '{"b":"x","a":[1,2]}',
        '{"x":1}': None,
        "bad": None,
        '{"_source":{"a":1}': None,
        '{"_source":null}': "null",
        "[1]": None,
    }
    df = spark.createDataFrame([(h,) for h in hits], "h STRING")
    assert {r.h: r.s for r in df.select("h", source_or_null(F.col("h")).alias("s")).collect()} == hits
    lenient = {r.h: r.s for r in df.select("h", unwrap_source_lenient(F.col("h")).alias("s")).collect()}
    assert lenient == {h: s or h for h, s in hits.items()}
    with pytest.raises(Exception, match="hit without _source"):
        df.select(unwrap_source(F.col("h"))).collect()


def test_merge_agg_json(spark):
    cases = [
        ('{"a":1,"b":{"x":1}}', '{"b":2,"c":[1]}', '{"a":1,"b":{"x":1},"c":[1]}'),
        ("", '{"b":2}', '{"b":2}'),
        (None, '{"b":2}', '{"b":2}'),
        ("[1]", '{"b":2}', "[1]"),
        ('{"a":1}', "nonsense", '{"a":1}'),
        ('{"a":1}', None, '{"a":1}'),
    ]
    df = spark.createDataFrame([(h, c) for h, c, _ in cases], "h STRING, c STRING")
    got = [r.m for r in df.select(merge_agg_json(F.col("h"), F.col("c")).alias("m")).collect()]
    assert got == [m for _, _, m in cases]
