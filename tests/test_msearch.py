"""Batched searches against brute force."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.plans import msearch, msearch_aggs, msearch_ends
from tidemark.sources.lines import EMPTY, ODD_LINES

NOW = datetime(2024, 2, 1)
START = datetime(2024, 1, 1, 5, 20)


def make_rows(rng):
    """Three tables of different density; half of all rows lie within one hour of one table."""
    rows = []
    for i in range(1200):
        if i % 2:
            index, ts = "hot-one", datetime(2024, 1, 10, 7) + timedelta(microseconds=rng.randrange(3_600_000_000))
        else:
            index, ts = rng.choice([("a", 20), ("b", 3)])
            ts = START + timedelta(microseconds=rng.randrange(int(ts * 86_400_000_000)))
        rows.append((i, index, ts, rng.choice(["hot", "cold"]), rng.choice([None, float(rng.randrange(40))])))
    rows.append((5000, "a", datetime(2024, 1, 12), "hot", 99.0))  # exactly at midnight
    rows.append((5001, "a", datetime(2024, 1, 12, 6), "hot", 98.0))  # exactly on an hour
    return rows


def make_requests(rng, rows):
    requests = []
    edges = [r[2] for r in rows[:40]] + [datetime(2024, 1, 12), datetime(2024, 1, 12, 6), datetime(2024, 1, 10, 7)]
    for i in range(120):
        lower, upper = sorted(
            rng.choice([rng.choice(edges), START + timedelta(microseconds=rng.randrange(25 * 86_400_000_000))]) for _ in range(2)
        )
        bounds = {}
        if rng.random() < 0.8:
            bounds[rng.choice(["gte", "gt"])] = lower.isoformat()
        if rng.random() < 0.8:
            bounds[rng.choice(["lte", "lt"])] = upper.isoformat()
        if rng.random() < 0.1:
            bounds = {"gte": upper.isoformat(), "lt": lower.isoformat()}  # empty range
        body = {"query": {"range": {"@timestamp": bounds}}, "from": rng.randrange(4), "size": rng.randrange(9)}
        sort = rng.choice([None, "_score", {"_score": "asc"}, [{"@timestamp": "desc"}], {"@timestamp": {"order": "asc"}}])
        if sort:
            body["sort"] = sort
        names = rng.choice([["a"], ["b", "a"], ["*"], ["hot-*", "a"], ["nothing"], ["[ab]", "a"]])
        requests.append((i, names, json.dumps(body)))
    return requests + [(900, ["a"], "not json"), (901, ["a"], '{"sort":["_score","x"]}'), (902, ["a"], '{"pit":1}')]


def hits_of(names, body, rows):
    wild = {"*": {"a", "b", "hot-one"}, "hot-*": {"hot-one"}, "[ab]": {"a", "b"}}
    bounds = {k: datetime.fromisoformat(v) for k, v in body["query"]["range"]["@timestamp"].items()}
    tables = set().union(*[wild.get(n, {n}) for n in names])
    return [
        r
        for r in rows
        if r[1] in tables
        and ("gte" not in bounds or r[2] >= bounds["gte"])
        and ("gt" not in bounds or r[2] > bounds["gt"])
        and ("lte" not in bounds or r[2] <= bounds["lte"])
        and ("lt" not in bounds or r[2] < bounds["lt"])
    ]


def expected(requests, rows):
    pages, totals = {}, {}
    for req_id, names, text in requests:
        if req_id >= 900:
            continue
        body = json.loads(text)
        hits = hits_of(names, body, rows)
        sort = json.dumps(body.get("sort", "_score"))
        value = (lambda r: r[2].timestamp()) if "timestamp" in sort else (lambda r: r[4] or 0.0)
        sign = 1 if "asc" in sort else -1
        hits.sort(key=lambda r: (sign * value(r), r[3] != "hot", r[1], r[0]))
        page = hits[body["from"] : body["from"] + body["size"]]
        pages[req_id] = [r[0] for r in page]
        totals[req_id] = (len(hits), max((r[4] or 0.0 for r in page), default=None))
    return pages, totals


@pytest.mark.parametrize("seed,dense_rows", [(1, 100_000), (2, 5)])
def test_against_brute_force(spark, seed, dense_rows):
    rng = random.Random(seed)
    rows = make_rows(rng)
    requests = make_requests(rng, rows)
    pages, totals = expected(requests, rows)
    table = spark.createDataFrame(rows, "event_id INT, index STRING, ts TIMESTAMP_NTZ, tier STRING, score DOUBLE")
    log = spark.createDataFrame(requests, "req_id INT, indices ARRAY<STRING>, body STRING")
    page, summary = msearch.answer(log, table, NOW, {"_score": "score", "@timestamp": "ts"}, dense_rows=dense_rows)
    got = {}
    for row in page.orderBy("req_id", "rank").collect():
        got.setdefault(row.req_id, []).append(row.key)
    assert got == {k: v for k, v in pages.items() if v}
    by_id = {r.req_id: r for r in summary.collect()}
    assert {k: (by_id[k].total, by_id[k].max_score) for k in totals} == totals
    assert {k: by_id[k].error for k in (900, 901, 902)} == {
        900: msearch.NOT_AN_OBJECT,
        901: msearch.UNSUPPORTED_ORDER,
        902: "pit is not supported for cross-tier merge",
    }
    assert {r.status for r in by_id.values()} == {200, 400}
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_queries_that_are_not_evaluated_are_refused(spark):
    span = {"range": {"@timestamp": {"gte": "2024-01-02"}}}
    refused = [
        {"bool": {"filter": [{"term": {"event_type": "view"}}, span]}},
        {"bool": {"must_not": [span]}},
        {"bool": {"filter": [span, {"range": {"@timestamp": {"lt": "2024-01-03"}}}]}},
        {"bool": {"filter": [span], "should": [span]}},
        {"bool": {"must": [{"bool": {"filter": [span]}}]}},
        {"range": {"created_at": {"gte": "2024-01-02"}}},
        {"range": {"@timestamp": {"gte": "someday"}}},
        {"range": {"@timestamp": {"gte": "2024-01-02", "gt": "2024-01-03"}}},
        {"range": {"@timestamp": {"gte": "2024-01-02", "boost": 2}}},
        {"match_all": {}, "range": span["range"]},
    ]
    taken = [span, {"bool": {"filter": span}}, {"bool": {"must": [span], "filter": []}}, None]
    bodies = [{"query": q} if q else {} for q in refused + taken]
    log = spark.createDataFrame([(i, ["a"], json.dumps(b)) for i, b in enumerate(bodies)], "req_id INT, indices ARRAY<STRING>, body STRING")
    plan = msearch.plan_requests(log, NOW, {"_score": "score"}).orderBy("req_id").collect()
    assert [r.error for r in plan] == [msearch.UNSUPPORTED_QUERY] * len(refused) + [None] * len(taken)


@pytest.mark.parametrize("seed,dense_rows", [(3, 100_000), (4, 5)])
def test_aggregations_against_brute_force(spark, seed, dense_rows):
    rng = random.Random(seed)
    rows = make_rows(rng)
    requests = [r for r in make_requests(rng, rows)[:60]]
    aggs = {
        "t": {"terms": {"field": "tier"}},
        "s": {"terms": {"field": "points", "size": 3}},
        "s2": {"terms": {"field": "points", "size": 1}},
        "h": {"date_histogram": {"field": "@timestamp", "calendar_interval": "hour"}},
        "d": {"date_histogram": {"field": "@timestamp", "fixed_interval": "1d"}},
        "avg": {"avg": {"field": "points"}},
        "nested": {"terms": {"field": "tier"}, "aggs": {"x": {"terms": {"field": "points"}}}},
        "unknown": {"terms": {"field": "other"}},
    }
    log = [(i, names, json.dumps(json.loads(text) | {"aggs": aggs})) for i, names, text in requests]
    table = spark.createDataFrame(rows, "event_id INT, index STRING, ts TIMESTAMP_NTZ, tier STRING, score DOUBLE")
    asked = spark.createDataFrame(
        [*log, (900, ["a"], "not json"), (901, ["a"], '{"pit":1,"aggs":{"t":{"terms":{"field":"tier"}}}}'), (902, ["a"], "{}")],
        "req_id INT, indices ARRAY<STRING>, body STRING",
    )
    buckets, refused = msearch_aggs.aggregate(
        asked, table, NOW, {"tier": "tier", "points": "score"}, {"_score": "score", "@timestamp": "ts"}, dense_rows=dense_rows
    )
    want = set()
    for i, names, text in log:
        hits = hits_of(names, json.loads(text), rows)
        by = {
            "t": Counter(r[3] for r in hits), "s": Counter(str(r[4]) for r in hits if r[4] is not None),
            "h": Counter(r[2].strftime("%Y-%m-%d %H:00:00") for r in hits), "d": Counter(r[2].strftime("%Y-%m-%d 00:00:00") for r in hits),
        }
        for name, size in (("t", 10), ("s", 3), ("s2", 1), ("h", None), ("d", None)):
            order = sorted(by[name[0]].items(), key=lambda b: (-b[1] if size else 0, b[0]))[:size]
            want |= {(i, name, place, value, n) for place, (value, n) in enumerate(order, 1)}
    assert {tuple(r) for r in buckets.collect()} == want
    errors = {(r.req_id, r.name): r.error for r in refused.collect()}
    assert set(errors) == {(i, n) for i, _, _ in log for n in ("avg", "nested", "unknown")} | {(901, "t")}
    assert set(errors.values()) == {msearch_aggs.UNSUPPORTED_AGGREGATION, "pit is not supported for cross-tier merge"}
    plan = buckets._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_responses_to_files_come_by_entry(spark):
    rows = make_rows(random.Random(5))
    table = spark.createDataFrame(rows, "event_id INT, index STRING, ts TIMESTAMP_NTZ, tier STRING, score DOUBLE")
    span = {"query": {"range": {"@timestamp": {"gte": "2024-01-02T00:00:00"}}}, "size": 3}
    files = {
        "good": ['{"index":"a, b"}', json.dumps(span), '{"index":"nothing"}', "{}", '{"index":"a"}', "not json"],
        "hot": ["{}", json.dumps(span), '{"index":"a"}', json.dumps(span)],
        "odd": ['{"index":"a"}'],
        "blank": ["", "  "],
    }
    lines = [(f, 0, i, text) for f, texts in files.items() for i, text in enumerate(texts)]
    found = msearch.answer_files(spark.createDataFrame(lines, "file STRING, chunk INT, position INT, text STRING"), table, NOW)
    got = {(r.file, r.entry): (r.status, r.error, r.total, [h.key for h in r.hits or []]) for r in found.collect()}

    def page(names, kept):
        hits = sorted(hits_of(names, span, kept), key=lambda r: (-(r[4] or 0.0), r[3] != "hot", r[1], r[0]))
        return 200, None, len(hits), [r[0] for r in hits[:3]]

    assert got == {
        ("good", 0): page(["a", "b"], rows),
        ("good", 1): (200, None, 0, []),
        ("good", 2): (400, msearch.NOT_AN_OBJECT, None, []),
        ("hot", 0): (200, None, 0, []),
        ("hot", 1): page(["a"], [r for r in rows if r[3] == "hot"]),
        ("odd", None): (400, ODD_LINES, None, []),
        ("blank", None): (400, EMPTY, None, []),
    }


@pytest.mark.parametrize("depth", [999, 1000, 50_000])
def test_ranks_are_bounded_before_the_shuffle_at_any_depth(spark, depth):
    table = spark.createDataFrame(make_rows(random.Random(6)), "event_id INT, index STRING, ts TIMESTAMP_NTZ, tier STRING, score DOUBLE")
    msearch.bound_ranks(spark, depth)
    ordered = msearch.ordered_rows(table, {"_score": "score"}, ["_score:desc"], "event_id", "score")
    best = msearch._best(ordered, ["index", "order_key"], depth)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,k", [(1, 1), (13, 3), (64, 16), (100, 200)])
def test_smallest_within_ranges(n, k):
    rng = np.random.default_rng(n)
    rank = rng.permutation(n).astype(np.int32)
    begin, end = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
    found = msearch_ends.smallest_within(rank, begin, end, k)
    for a, b, row in zip(begin.tolist(), end.tolist(), found.tolist()):
        best = sorted(rank[a:b].tolist())[:k]
        assert row == best + [n] * (k - len(best))


def test_many_ends_in_one_hour_are_not_compared_with_all_its_rows(spark):
    rng = random.Random(7)
    hour = datetime(2024, 1, 10, 7)
    rows = [(i, "a", hour + timedelta(seconds=rng.randrange(3600)), rng.choice(["hot", "cold"]), float(rng.randrange(9))) for i in range(400)]
    requests = []
    for i in range(300):
        first, last = sorted(hour + timedelta(seconds=rng.randrange(3600)) for _ in range(2))
        body = {"query": {"range": {"@timestamp": {"gte": first.isoformat(), "lt": last.isoformat()}}}, "from": i % 3, "size": 4}
        requests.append((i, ["a"], json.dumps(body | ({"sort": {"_score": "asc"}} if i % 2 else {}))))
    pages, totals = expected(requests, rows)
    table = spark.createDataFrame(rows, "event_id INT, index STRING, ts TIMESTAMP_NTZ, tier STRING, score DOUBLE")
    log = spark.createDataFrame(requests, "req_id INT, indices ARRAY<STRING>, body STRING")
    edges = spark.createDataFrame([("a", hour, i) for i in range(300)] + [("b", hour, 0)], "index STRING, bucket TIMESTAMP_NTZ, req_id INT")
    sizes = spark.createDataFrame([("a", hour, 400), ("b", hour, 400)], "index STRING, bucket TIMESTAMP_NTZ, n INT")
    few, many = msearch_ends.split_ends(edges, sizes, msearch.DENSE_ROWS)
    assert (few.count(), many.count()) == (1, 300)
    page, summary = msearch.answer(log, table, NOW, {"_score": "score"})
    got = {}
    for row in page.orderBy("req_id", "rank").collect():
        got.setdefault(row.req_id, []).append(row.key)
    assert got == {k: v for k, v in pages.items() if v}
    assert {r.req_id: (r.total, r.max_score) for r in summary.collect()} == totals


def test_aggregations_of_many_ends_in_one_hour_are_not_joined_with_its_rows(spark):
    rng = random.Random(8)
    hour = datetime(2024, 1, 10, 7)
    rows = [(i, "a", hour + timedelta(seconds=rng.randrange(3600)), "hot", rng.choice([None, *map(float, range(9))])) for i in range(400)]
    requests = []
    for i in range(300):
        first, last = sorted(hour + timedelta(seconds=rng.randrange(3600)) for _ in range(2))
        body = {"query": {"range": {"@timestamp": {"gte": first.isoformat(), "lt": last.isoformat()}}}}
        aggs = {"s": {"terms": {"field": "points", "size": 4}}} | ({"h": {"date_histogram": {"field": "@timestamp", "fixed_interval": "1h"}}} if i % 2 else {})
        requests.append((i, rng.choice([["a"], ["*"]]), json.dumps(body | {"aggs": aggs})))
    table = spark.createDataFrame(rows, "event_id INT, index STRING, ts TIMESTAMP_NTZ, tier STRING, score DOUBLE")
    log = spark.createDataFrame(requests, "req_id INT, indices ARRAY<STRING>, body STRING")
    buckets, _ = msearch_aggs.aggregate(log, table, NOW, {"points": "score"})
    want = set()
    for i, names, text in requests:
        hits = hits_of(names, json.loads(text), [(*r[:1], "a", *r[2:]) for r in rows])
        kinds = sorted(Counter(str(r[4]) for r in hits if r[4] is not None).items(), key=lambda b: (-b[1], b[0]))[:4]
        want |= {(i, "s", place, value, n) for place, (value, n) in enumerate(kinds, 1)}
        if i % 2 and hits:
            want.add((i, "h", 1, "2024-01-10 07:00:00", len(hits)))
    assert {tuple(r) for r in buckets.collect()} == want
    assert "CoGroup" in buckets._jdf.queryExecution().executedPlan().toString()
