"""Packing of cold and folding of state logs: the same rows, fewer files, at any point of a crash."""

import shutil
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from test_lifecycle import ALL, NOW, event_rows, ids, older, shown
from tidemark.plans import packing
from tidemark.plans.migrate import apply_retention, migrate
from tidemark.plans.packing import fold_states, pack_cold, unfinished_batches
from tidemark.plans.store import TierStore
from tidemark.sources import state
from tidemark.sources.files import read_table
from tidemark.sources.state import KEYS, SCHEMAS, get_state


@pytest.fixture(scope="module")
def template(spark, tmp_path_factory):
    """Three runs of three tables in two slices: many small files."""
    rows = event_rows(spark)
    made = TierStore(spark, str(tmp_path_factory.mktemp("template") / "store"), StructType(rows.schema.fields[:2]))
    made.append_hot(rows)
    for days in (14, 7, 0):
        migrate(made, NOW - timedelta(days=days), 7, slices=2)
    return made


@pytest.fixture
def store(template, tmp_path):
    shutil.copytree(template.root, tmp_path / "store")
    return replace(template, root=str(tmp_path / "store"))


def files(store):
    return read_table(store.spark, store.cold_path, store.cold_schema).inputFiles()


def contents(df):
    return sorted(map(str, df.collect()))


def test_rows_stay_and_files_go(spark, store):
    before, count = contents(store.cold().drop("batch", "slice")), len(files(store))
    assert count >= 18
    assert pack_cold(store) == count
    assert len(files(store)) == 3
    assert contents(store.cold().drop("batch", "slice")) == before
    assert shown(store) == list(range(ALL))
    assert pack_cold(store) == 0  # one small file a table: nothing to gain


def test_packed_with_what_came_after(spark, store):
    pack_cold(store)
    migrate(store, NOW + timedelta(days=3), 7, slices=2)
    count = len(files(store))
    assert count >= 6 and pack_cold(store) == count
    assert len(files(store)) == 3
    assert ids(store.cold()) == older(NOW - timedelta(days=4))


def test_bins_hold_less_than_three_times_the_target(spark, tmp_path):
    rows = spark.range(20000).selectExpr(
        "IF(id < 6000, NULL, CAST(id AS INT)) AS event_id", "TIMESTAMP_NTZ'2026-01-01 00:00:00' AS ts", "'t' AS index"
    )
    made = TierStore(spark, str(tmp_path / "store"), StructType(rows.schema.fields[:2]))
    made.append_hot(rows.repartition(40))
    migrate(made, NOW, 7, slices=4)
    target = sum(r["bytes"] for r in packing.cold_batches(made).collect()) // 6 + 1
    before = contents(made.cold().select("event_id", "ts", "index"))
    assert pack_cold(made, target) == 32
    held = made.cold().groupBy("slice").count().collect()
    assert len(held) == len(files(made)) == 6 and max(r["count"] for r in held) < 3 * 20000 / 6
    assert contents(made.cold().select("event_id", "ts", "index")) == before


def test_files_of_target_size_are_left_alone(spark, store):
    count = len(files(store))
    assert pack_cold(store, target_bytes=1) == 0
    assert len(files(store)) == count


STEPS = ["overwrite_partitions", "commit", "finish"]


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", STEPS)
def test_crash_at_any_step(spark, store, monkeypatch, step, when):
    """Readers see every row once after a crash, and so does whoever comes after the next job."""
    before, count = ids(store.cold()), len(files(store))
    owner, name = (TierStore, "finish_packing") if step == "finish" else (packing, step)
    inner = getattr(owner, name)
    calls = []

    def lost(*arguments):
        calls.append(name)
        if step == "finish" and len(calls) == 1:  # the one that prepares the job
            return inner(*arguments)
        if when == "after":
            inner(*arguments)
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(owner, name, lost)
        with pytest.raises(RuntimeError, match="lost"):
            pack_cold(store)
    assert ids(store.cold()) == before
    assert shown(store) == list(range(ALL))
    store.prepare()
    assert ids(store.cold()) == before
    committed = step == "finish" or (step, when) == ("commit", "after")
    assert len(files(store)) == (3 if committed else count)
    pack_cold(store)
    assert ids(store.cold()) == before and len(files(store)) == 3


def test_crash_while_old_files_go(spark, store, monkeypatch):
    before = ids(store.cold())
    from tidemark.plans import store as stores

    inner, calls = stores.remove, []

    def lost(session, path):
        calls.append(path)
        if "/cold/" in path and len([c for c in calls if "/cold/" in c]) == 4:
            raise RuntimeError("lost")
        inner(session, path)

    with monkeypatch.context() as patched:
        patched.setattr(stores, "remove", lost)
        with pytest.raises(RuntimeError, match="lost"):
            pack_cold(store)
    assert ids(store.cold()) == before
    apply_retention(store, NOW, {}, 0)
    migrate(store, NOW, 7)
    assert ids(store.cold()) == before and len(files(store)) == 3


def test_unfinished_batches_are_left(spark, store, monkeypatch):
    """A run whose slices are copied but not recorded writes its batch again: it must not be packed meanwhile."""
    from tidemark.plans import migrate as jobs

    def lost(*arguments):
        raise RuntimeError("lost")

    later = NOW + timedelta(days=2)
    with monkeypatch.context() as patched:
        patched.setattr(jobs, "copied_counts", lost)
        with pytest.raises(Exception, match="failed"):
            migrate(store, later, 7, slices=2)
    open_batches = {r["batch"] for r in unfinished_batches(store).collect()}
    assert open_batches == {"w20260126000000"}
    pack_cold(store)
    assert {r["batch"][:1] for r in store.cold().select("batch").distinct().collect()} == {"p", "w"}
    migrate(store, later, 7, slices=2)
    assert ids(store.cold()) == older(NOW - timedelta(days=5))
    pack_cold(store)
    assert ids(store.cold()) == older(NOW - timedelta(days=5)) and len(files(store)) == 3


def test_names_with_odd_characters(spark, tmp_path):
    names = ["a+b", "c d", "e:f%3A", "ü=1"]
    rows = event_rows(spark).withColumn("index", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 4 + 1).cast("int")))
    made = TierStore(spark, str(tmp_path / "store"), StructType(rows.schema.fields[:2]))
    made.append_hot(rows)
    migrate(made, NOW, 7, slices=2)
    before = contents(made.cold().drop("batch", "slice"))
    assert pack_cold(made) >= 8
    assert contents(made.cold().drop("batch", "slice")) == before and len(files(made)) == 4


def test_empty_store(spark, tmp_path):
    made = TierStore(spark, str(tmp_path / "store"), StructType(event_rows(spark).schema.fields[:2]))
    assert pack_cold(made) == 0
    fold_states(made)
    assert made.cold().count() == 0


def logs(store):
    return {t: len(read_table(store.spark, f"{store.root}/state/{t}", SCHEMAS[t]).inputFiles()) for t in KEYS}


def test_logs_are_folded(spark, store):
    before, long = {t: contents(get_state(spark, store.root, t)) for t in KEYS}, logs(store)
    fold_states(store)
    assert {t: contents(get_state(spark, store.root, t)) for t in KEYS} == before
    assert all(n <= 1 for n in logs(store).values()) and sum(long.values()) > 10
    migrate(store, NOW + timedelta(days=3), 7, slices=2)
    assert ids(store.cold()) == older(NOW - timedelta(days=4))


@pytest.mark.parametrize("step", ["put_state", "remove_files"])
def test_fold_cut_short(spark, store, monkeypatch, step):
    before = {t: contents(get_state(spark, store.root, t)) for t in KEYS}
    inner = getattr(state, step)

    def lost(*arguments):
        if step == "put_state":
            inner(*arguments)
        else:
            inner(arguments[0], arguments[1][:1])
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(state, step, lost)
        with pytest.raises(RuntimeError, match="lost"):
            fold_states(store)
    assert {t: contents(get_state(spark, store.root, t)) for t in KEYS} == before
    fold_states(store)
    assert {t: contents(get_state(spark, store.root, t)) for t in KEYS} == before
