"""Members of JSON text come out spelled as they went in."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.documents import merge_agg_json, raw_members, source_or_null, unwrap_source_lenient
from tidemark.plans.search import needed_by_marks, tiered_rows

BIG = "123456789012345678901234567890123"
CASES = [
    ('{"_source":1.10}', "1.10"), ('{"_source":%s}' % BIG, BIG), ('{"_source":1e400}', "1e400"), ('{"_source": "a\\"}b" }', '"a\\"}b"'),
    ('{"_source":{"a": 1.0,\n "b":[1, {"_source":2}]},"x":"}"}', '{"a": 1.0,\n "b":[1, {"_source":2}]}'),
    ('{"_source":1,"y":{"_source":2},"_source": [ ] }', "[ ]"), ('{"\\u005fsource":true}', "true"), ('{"_source":null}', "null"),
    (' \t{ "a" : "" , "_source"\n:\n-0.0E-7\n} ', "-0.0E-7"), ('{"x":{"_source":1}}', None), ("{}", None), ("[1]", None), ("", None),
    ("{_source:1}", None), ('{"_source":1} x', None), (None, None), ('{"_source":"%s"}' % ("é\\\\" * 5000), '"%s"' % ("é\\\\" * 5000)),
    ('{"_source":%s}' % ("[" * 200 + "]" * 200), "[" * 200 + "]" * 200),
]


def test_source_is_cut_out_unchanged(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, hit string")
    got = rows.select("i", source_or_null(F.col("hit")).alias("s"), unwrap_source_lenient(F.col("hit")).alias("l")).collect()
    for row in got:
        text, want = CASES[row["i"]]
        assert row["s"] == want and row["l"] == (text if want is None else want), text


def spelled(rng, depth=0):
    """Random JSON text with odd blanks; of an object also its members by hand."""
    blank = lambda: rng.choice(["", "", " ", "\n", "\t "])
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind < 4:
        return rng.choice(["1", "-2.50", "true", "null", '"a,b"', '"}\\\\"', '"\\"{"', "1E5"])
    parts = [spelled(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == 4:
        return "[" + ",".join(blank() + p + blank() for p in parts) + "]"
    return "{" + ",".join(f'{blank()}"k{rng.randint(0, 2)}"{blank()}:{blank()}{p}{blank()}' for p in parts) + "}"


def test_members_of_random_objects(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        members = [(rng.choice(["a", "b", "c d", "_source"]), spelled(rng)) for _ in range(rng.randint(0, 4))]
        rows.append((i, "{" + " ,".join(f' "{n}" : {v} ' for n, v in members) + "}", dict(members)))
    frame = spark.createDataFrame([r[:2] for r in rows], "i int, t string")
    for row in frame.select("i", raw_members(F.col("t")).alias("m")).collect():
        text, want = rows[row["i"]][1:]
        assert json.loads(text).keys() == want.keys()
        assert {m["name"]: m["value"] for m in row["m"]} == want and len(row["m"]) == len(want), text


def test_merged_results_keep_their_spelling(spark):
    cases = [
        ('{"a":1.10,"b":{"x": %s}}' % BIG, '{"b":0,"c": 1e400}', '{"a":1.10,"b":{"x": %s},"c":1e400}' % BIG),
        ("[1]", '{"a":1}', "[1]"), ('{"a":1}', "x", '{"a":1}'), (None, '{"a": 2.0}', '{"a": 2.0}'), ("", "[]", "[]"),
        ('{"a":1}', None, '{"a":1}'), ("{}", '{"q\\"":1}', '{"q\\"":1}'), ('{"a":1,"a":2}', '{"a":3}', '{"a":2}'),
    ]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, h string, c string")
    got = {r["i"]: r["m"] for r in frame.select("i", merge_agg_json(F.col("h"), F.col("c")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


@pytest.fixture(scope="module")
def tiers_and_marks(spark, tmp_path_factory):
    from datetime import datetime, timedelta

    from pyspark.sql.types import StructType

    from tidemark.plans.migrate import migrate
    from tidemark.plans.store import TierStore

    rows = spark.range(240).selectExpr(
        "CAST(id AS INT) AS event_id", "TIMESTAMP_NTZ'2026-01-01 00:30:00' + make_dt_interval(0, CAST(id * 3 AS INT)) AS ts",
        "concat('t', id % 3) AS index",
    )
    store = TierStore(spark, str(tmp_path_factory.mktemp("s") / "store"), StructType(rows.schema.fields[:2]))
    store.append_hot(rows)
    migrate(store, datetime(2026, 1, 31), 7, patterns=["t0"])
    migrate(store, datetime(2026, 1, 31) - timedelta(days=10), 7, patterns=["t1"])
    return store


RANGES = {  # tables, range: tiers needed (hot, cold)
    (("t0", "t1"), 2, 13): (False, True), (("t0", "t1"), 24, 30): (True, False), (("t0", "t1"), 13, 15): (True, True),
    (("t0",), 14, 23): (False, True), (("t1",), 14, 23): (True, False), (("t0", "t2"), 2, 13): (True, True), (("t2",), 2, 13): (True, False),
    (("none",), 2, 13): (False, False),
}


@pytest.mark.parametrize("case", list(RANGES))
def test_tiers_are_left_out_by_marks(spark, tiers_and_marks, case):
    from datetime import datetime, timedelta

    store, (names, a, b) = tiers_and_marks, case
    start, end = datetime(2026, 1, a, 1), datetime(2026, 1, b)
    chosen = F.col("index").isin(*names)
    needed = needed_by_marks(store.marks().where(chosen), store.hot_names().where(chosen), start, end)
    found = tiered_rows(store.hot(), store.cold(), store.marks(), start, end, list(names), tables=store.hot_names())
    plan = found._jdf.queryExecution().optimizedPlan().toString() + "".join(found.inputFiles())
    if RANGES[case] != (False, False):
        assert needed == RANGES[case]
        assert ("/hot/" in plan, "/cold/" in plan) == needed
    want = sorted(
        i for i in range(240)
        if f"t{i % 3}" in names and start <= datetime(2026, 1, 1, 0, 30) + timedelta(hours=3 * i) <= end
    )
    assert sorted(r["event_id"] for r in found.collect()) == want
