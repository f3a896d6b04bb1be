"""Windows, runs, resumes, purges, retention and the streaming copy."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.documents import unwrap_source
from tidemark.operators import tiers
from tidemark.operators.retention import retention_limits
from tidemark.operators.windows import in_purge_window, in_window, sliced
from tidemark.plans.migrate import MigrationError, apply_retention, migrate
from tidemark.plans.store import TierStore
from tidemark.sources.files import overwrite_partitions, rewrite_keeping
from tidemark.sources.lines import read_documents, write_documents
from tidemark.sources.state import get_state, put_state
from tidemark.streaming.copy import ProgressLog, start_copy

NOW = datetime(2026, 1, 31)
ALL = 240


def event_rows(spark, start=0, end=ALL):
    """Three tables, one row every three hours from the first of January."""
    return spark.range(start, end).selectExpr(
        "CAST(id AS INT) AS event_id",
        "TIMESTAMP_NTZ'2026-01-01 00:30:00' + make_dt_interval(0, CAST(id * 3 AS INT)) AS ts",
        "concat('t', id % 3) AS index",
    )


@pytest.fixture
def store(spark, tmp_path):
    rows = event_rows(spark)
    made = TierStore(spark, str(tmp_path / "store"), StructType(rows.schema.fields[:2]))
    made.append_hot(rows)
    return made


def ids(df):
    return sorted(r.event_id for r in df.collect())


def older(moment):
    return [i for i in range(ALL) if datetime(2026, 1, 1, 0, 30) + timedelta(hours=3 * i) < moment]


def shown(store):
    return ids(tiers.union_exact(store.hot(), store.cold(), store.marks()))


def test_windows_tile_time(spark):
    rows = spark.range(4000).selectExpr("TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.37) AS ts")
    cuts = [None, "2026-01-01 00:00:10.9", "2026-01-01 00:05:00.25", "2026-01-01 00:05:00.75", "2026-01-01 00:20:00", "2026-01-02 00:00:00"]
    literal = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    hits = sum((in_window(F.col("ts"), a, b).cast("int") for a, b in zip(literal, literal[1:])), F.lit(0))
    assert [tuple(r) for r in rows.groupBy(hits.alias("n")).count().collect()] == [(1, 4000)]


def test_purge_window_stops_an_hour_earlier(spark):
    end = F.lit("2026-01-02 00:00:00").cast("timestamp_ntz")
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2026-01-01 22:59:59' AS ts UNION ALL SELECT TIMESTAMP_NTZ'2026-01-01 23:00:00'")
    assert rows.where(in_purge_window(F.col("ts"), F.lit(None).cast("timestamp_ntz"), end)).count() == 1


def test_slices_partition_the_rows(spark):
    rows = sliced(event_rows(spark), 4, F.col("event_id"))
    assert rows.where("slice < 0 OR slice > 3").count() == 0
    assert rows.select("slice").distinct().count() == 4
    assert sliced(event_rows(spark), 1, F.col("event_id")).where("slice <> 0").count() == 0


def test_incremental_runs(spark, store):
    assert migrate(store, NOW - timedelta(days=10), 7) == len(older(datetime(2026, 1, 14)))
    assert ids(store.cold()) == older(datetime(2026, 1, 14))
    assert migrate(store, NOW, 7) == len(older(datetime(2026, 1, 24))) - len(older(datetime(2026, 1, 14)))
    assert ids(store.cold()) == older(datetime(2026, 1, 24))
    assert migrate(store, NOW, 7) == 0  # nothing left, nothing changed
    assert ids(store.cold()) == older(datetime(2026, 1, 24))
    assert shown(store) == list(range(ALL))
    assert {r.migrated_before for r in store.marks().collect()} == {datetime(2026, 1, 24)}
    runs = get_state(spark, store.root, "run_metrics")
    assert runs.agg(F.sum("documents_migrated")).first()[0] == len(older(datetime(2026, 1, 24)))
    assert {r.status for r in runs.collect()} == {"success"}


def test_only_selected_and_ripe_tables(spark, tmp_path):
    rows = event_rows(spark).withColumn(
        "index", F.when(F.col("index") == "t0", F.lit("logs-2026.01.30")).when(F.col("index") == "t1", F.lit("logs-2025.12.01")).otherwise(F.lit(".own"))
    )
    store = TierStore(spark, str(tmp_path / "store"), StructType(rows.schema.fields[:2]))
    store.append_hot(rows)
    migrate(store, NOW, 7)
    assert {r["index"] for r in store.cold().select("index").distinct().collect()} == {"logs-2025.12.01"}


def test_failed_wave_is_resumed_with_its_cutoff(spark, store):
    def fails_on_t1(rows):
        return rows.withColumn("ts", F.when(F.col("index") == "t1", F.raise_error(F.lit("lost"))).otherwise(F.col("ts")))

    first = NOW - timedelta(days=10)
    with pytest.raises(MigrationError):
        migrate(store, first, 7, slices=2, waves=8, transform=fails_on_t1)
    done = {r["index"] for r in store.marks().collect()}
    assert done == {"t0", "t2"}
    failed = get_state(spark, store.root, "run_metrics").where("status = 'failed'").collect()
    assert [r["index"] for r in failed] == ["t1"] and failed[0].error
    assert shown(store) == list(range(ALL))
    # The next run, days later and with another slice count, finishes t1 up to the old cutoff.
    migrate(store, NOW, 7, patterns=["t1"], slices=5)
    marks = {r["index"]: r.migrated_before for r in store.marks().collect()}
    assert marks["t1"] == datetime(2026, 1, 14)
    migrate(store, NOW, 7)
    assert ids(store.cold()) == older(datetime(2026, 1, 24))
    assert shown(store) == list(range(ALL))


def test_one_bad_table_of_many_in_one_wave(spark, tmp_path):
    """With default arguments the tables that can be read are copied, marked and recorded."""
    rows = event_rows(spark).withColumn("index", F.concat(F.lit("n"), F.col("event_id") % 7))
    store = TierStore(spark, str(tmp_path / "store"), StructType(rows.schema.fields[:2]))
    store.append_hot(rows)
    bad = F.col("index") == "n4"
    jobs = []

    def fails(found):
        jobs.append(1)
        return found.withColumn("ts", F.when(bad, F.raise_error(F.lit("lost"))).otherwise(F.col("ts")))

    with pytest.raises(MigrationError):
        migrate(store, NOW, 7, late=False, transform=fails)
    assert {r["index"] for r in store.marks().collect()} == {f"n{i}" for i in range(7)} - {"n4"}
    runs = {(r["index"], r.status) for r in get_state(spark, store.root, "run_metrics").collect()}
    assert runs == {(f"n{i}", "failed" if i == 4 else "success") for i in range(7)}
    assert len(jobs) < 13  # not a job for each table
    assert shown(store) == list(range(ALL))
    migrate(store, NOW, 7)
    assert ids(store.cold()) == older(datetime(2026, 1, 24))
    assert shown(store) == list(range(ALL))


def test_done_slices_are_not_copied_again(spark, store):
    """A run cut short after slice 0 of t0: only the rest is copied, and copying twice changes nothing."""
    state = spark.sql(
        "SELECT 't0' AS index, TIMESTAMP_NTZ'2026-01-20 00:00:00' AS cutoff_time, 2 AS slice_max, id AS slice_id, "
        "CAST(0 AS BIGINT) AS migrated, id = 0 AS done, TIMESTAMP_NTZ'2026-01-27 00:00:00' AS updated_at FROM range(2)"
    ).withColumn("slice_id", F.col("slice_id").cast("int"))
    put_state(state, store.root, "slice_state")
    migrate(store, NOW, 7, patterns=["t0"], late=False)  # late would copy what the made-up state claims was done
    parts = {(r.batch, r.slice) for r in store.cold().select("batch", "slice").distinct().collect()}
    assert parts == {("w20260120000000", 1)}


def test_crash_before_the_state_is_written(spark, store, monkeypatch):
    import tidemark.plans.migrate as job

    def crash(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(job, "copied_counts", crash)
        with pytest.raises(MigrationError):
            migrate(store, NOW, 7, slices=3)
    assert store.marks().count() == 0 and store.cold().count() > 0
    assert shown(store) == list(range(ALL))  # unmarked tables are read from hot
    migrate(store, NOW + timedelta(days=2), 7, slices=5)
    assert ids(store.cold()) == older(datetime(2026, 1, 24))
    assert shown(store) == list(range(ALL))


def test_purge(spark, store):
    migrate(store, NOW - timedelta(days=10), 7, delete_after=True)
    left = [i for i in range(ALL) if i not in older(datetime(2026, 1, 13, 23))]
    assert ids(store.hot()) == left
    migrate(store, NOW, 7, delete_after=True)  # takes the hour left standing along
    assert ids(store.hot()) == [i for i in range(ALL) if i not in older(datetime(2026, 1, 23, 23))]
    assert shown(store) == list(range(ALL))


def test_purge_that_failed_is_made_up_for(spark, store, monkeypatch):
    import tidemark.plans.migrate as job

    def crash(*_):
        raise RuntimeError("no")

    with monkeypatch.context() as patch:
        patch.setattr(job, "rewrite_keeping", crash)
        with pytest.raises(MigrationError):
            migrate(store, NOW, 7, delete_after=True)
    assert store.marks().count() == 3 and shown(store) == list(range(ALL))  # the marks do not wait for the purge
    assert migrate(store, NOW, 7, delete_after=True) == 0  # slices were done, only the purge was not
    assert ids(store.hot()) == [i for i in range(ALL) if i not in older(datetime(2026, 1, 23, 23))]
    assert shown(store) == list(range(ALL))


def added(spark, event_id, ts):
    return spark.sql(f"SELECT {event_id} AS event_id, TIMESTAMP_NTZ'{ts}' AS ts, 't1' AS index")


def test_row_in_the_hour_left_standing_is_not_lost(spark, store):
    migrate(store, NOW - timedelta(days=10), 7, delete_after=True)
    store.append_hot(added(spark, 900, "2026-01-13 23:40:00"))  # twenty minutes before the cutoff, after the copy
    store.append_hot(added(spark, 901, "2026-01-02 00:00:00"))  # before what was purged
    migrate(store, NOW, 7, delete_after=True)
    assert shown(store) == [*range(ALL), 900, 901]
    assert not {900, 901} & set(ids(store.hot()))


def test_row_appended_between_copy_and_purge_stays(spark, store, monkeypatch):
    import tidemark.plans.migrate as job

    real = job.purge

    def append_first(made, *args):
        made.append_hot(added(spark, 902, "2026-01-05 00:10:00"))
        real(made, *args)

    with monkeypatch.context() as patch:
        patch.setattr(job, "purge", append_first)
        migrate(store, NOW, 7, delete_after=True)
    assert 902 in ids(store.hot())
    late = tiers.union_exact(store.hot(), store.cold(), store.marks(), include_late=True)
    assert ids(late) == [*range(ALL), 902]
    migrate(store, NOW + timedelta(days=1), 7, delete_after=True)
    assert shown(store) == [*range(ALL), 902]


def test_stopped_after_the_purge(spark, store, monkeypatch):
    import tidemark.plans.migrate as job

    put = job.put_state

    def lost(rows, root, name):
        if name == "purge_mark":
            raise RuntimeError("driver lost")
        put(rows, root, name)

    with monkeypatch.context() as patch:
        patch.setattr(job, "put_state", lost)
        with pytest.raises(MigrationError):
            migrate(store, NOW, 7, delete_after=True)
    assert shown(store) == list(range(ALL))
    migrate(store, NOW, 7, delete_after=True)
    assert shown(store) == list(range(ALL))


def test_rewrite_cut_short_at_any_point(spark, store, tmp_path, monkeypatch):
    """Lost before the file list is written: nothing happened. Lost after: finished next time."""
    import tidemark.sources.files as files

    staging = str(tmp_path / "staging")
    args = (spark, store.hot_path, store.hot_schema, ["index"], lambda r: r.withColumn("_keep", F.expr("index <> 't0' AND event_id > 100")), staging)
    finish, calls = files.finish_rewrite, []

    def crash_at_the_end(*a):
        calls.append(a)
        if len(calls) > 1:
            raise RuntimeError("driver lost")
        finish(*a)

    with monkeypatch.context() as patch:
        patch.setattr(files, "finish_rewrite", crash_at_the_end)
        with pytest.raises(RuntimeError):
            rewrite_keeping(*args)
    assert ids(store.hot()) == list(range(ALL))
    store.append_hot(spark.sql("SELECT 7 AS event_id, TIMESTAMP_NTZ'2026-01-05 00:00:00' AS ts, 't1' AS index"))
    finish(*args[:2], staging)
    finish(*args[:2], staging)
    assert ids(store.hot()) == [7] + [i for i in range(101, ALL) if i % 3]
    (tmp_path / "staging" / "rows" / "index=t1").mkdir(parents=True)  # staged rows without a file list
    finish(*args[:2], staging)
    assert ids(store.hot()) == [7] + [i for i in range(101, ALL) if i % 3] and not (tmp_path / "staging").exists()


def test_table_names_with_odd_characters(spark, tmp_path):
    rows = event_rows(spark).withColumn("index", F.concat(F.col("index"), F.lit(" a:b%[c]*")))
    store = TierStore(spark, str(tmp_path / "store"), StructType(rows.schema.fields[:2]))
    store.append_hot(rows)
    migrate(store, NOW, 7, patterns=["t1*", "t0 a:b%[[]c]*"], delete_after=True)
    moved = [i for i in older(datetime(2026, 1, 24)) if i % 3 != 2]
    assert ids(store.cold()) == moved
    assert shown(store) == list(range(ALL))


def test_retention(spark, store):
    migrate(store, NOW, 7)
    apply_retention(store, NOW, {"t0": 0, "t1": 1}, 20)
    kept = ids(store.cold())
    cold = older(datetime(2026, 1, 24))
    young = [i for i in cold if i not in older(datetime(2026, 1, 11))]
    assert kept == sorted([i for i in cold if i % 3 == 0] + [i for i in young if i % 3 == 2])


def test_limits_are_found_once_per_table(spark):
    names = spark.createDataFrame([("t1",), ("t2",), ("own",), ("ever",), (None,)], "index STRING")
    rules = {"t*": 3, "t2": 5, "ever": 0}
    limits = {r["index"]: r["kept_from"] for r in retention_limits(names, NOW, rules, 9).collect()}
    assert limits == {"t1": NOW - timedelta(days=3), "t2": NOW - timedelta(days=5), "own": NOW - timedelta(days=9)}
    assert retention_limits(names, NOW, {}, 0).isEmpty()


def test_documents_are_unwrapped_on_the_way(spark, tmp_path):
    rows = event_rows(spark).withColumn("doc", F.concat(F.lit('{"_id":"x","_source":{"n":'), "event_id", F.lit("}}")))
    rows = rows.select("event_id", "ts", "doc", "index")
    store = TierStore(spark, str(tmp_path / "store"), StructType(rows.schema.fields[:3]))
    store.append_hot(rows)
    migrate(store, NOW, 7, transform=lambda r: r.withColumn("doc", unwrap_source(F.col("doc"))))
    assert {r.doc for r in store.cold().collect()} == {'{"n":%d}' % i for i in older(datetime(2026, 1, 24))}
    path = str(tmp_path / "lines")
    write_documents(store.cold(), path, "doc", compress=True)
    assert read_documents(spark, path).count() == len(older(datetime(2026, 1, 24)))
    assert ids(read_documents(spark, path, "n INT").withColumnRenamed("n", "event_id")) == older(datetime(2026, 1, 24))


def test_overwriting_a_slice_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = event_rows(spark).withColumn("slice", F.col("event_id") % 2)
    for _ in range(2):
        overwrite_partitions(rows, path, ["index", "slice"], [F.col("ts")])
    overwrite_partitions(rows.where("slice = 1"), path, ["index", "slice"])
    assert spark.read.parquet(path).count() == ALL


def test_streaming_copy(spark, store, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")
    log = ProgressLog()
    spark.streams.addListener(log)

    def trigger(now):
        start_copy(store, checkpoint, lambda: now, 7).awaitTermination()

    trigger(NOW - timedelta(days=10))
    assert ids(store.cold()) == older(datetime(2026, 1, 14))
    late = spark.sql("SELECT 1000 AS event_id, TIMESTAMP_NTZ'2026-01-05 00:00:00' AS ts, 't1' AS index")
    fresh = spark.sql("SELECT 1001 AS event_id, TIMESTAMP_NTZ'2026-01-20 00:00:00' AS ts, 't1' AS index")
    store.append_hot(late.union(fresh))
    trigger(NOW)
    assert ids(store.cold()) == older(datetime(2026, 1, 24)) + [1000, 1001]
    assert shown(store) == list(range(ALL)) + [1000, 1001]
    trigger(NOW)
    assert ids(store.cold()) == older(datetime(2026, 1, 24)) + [1000, 1001]
    for _ in range(50):  # the listener is told a moment later
        if log.rows:
            break
        time.sleep(0.1)
    spark.streams.removeListener(log)
    assert log.rows >= 2


def test_empty_store(spark, tmp_path):
    store = TierStore(spark, str(tmp_path / "store"), StructType(event_rows(spark).schema.fields[:2]))
    assert migrate(store, NOW, 7, delete_after=True) == 0
    apply_retention(store, NOW, {}, 20)
    assert shown(store) == []


# --- the ledger of files


def keyless(spark, ts, index="t1"):
    return spark.sql(f"SELECT CAST(NULL AS INT) AS event_id, TIMESTAMP_NTZ'{ts}' AS ts, '{index}' AS index")


def opened_files(store, monkeypatch, run):
    """Files whose rows the late pass asked for during ``run``."""
    import tidemark.plans.migrate as job

    asked, real = [], job.late_rows_of_new_files

    def watched(made, pending):
        asked.extend(pending.collect())
        return real(made, pending)

    with monkeypatch.context() as patch:
        patch.setattr(job, "late_rows_of_new_files", watched)
        run()
    return asked


def test_rows_without_a_key_are_copied_once(spark, store):
    migrate(store, NOW, 7)
    store.append_hot(keyless(spark, "2026-01-03 00:00:00").union(keyless(spark, "2026-01-03 00:00:00")))
    for hour in range(3):
        migrate(store, NOW + timedelta(hours=hour), 7)
        assert store.cold().where("event_id IS NULL").count() == 2
        seen = tiers.union_exact(store.hot(), store.cold(), store.marks())
        assert seen.where("event_id IS NULL").count() == 2


def test_a_run_without_new_files_reads_nothing_behind_the_marks(spark, store, monkeypatch):
    migrate(store, NOW, 7)
    assert opened_files(store, monkeypatch, lambda: migrate(store, NOW + timedelta(hours=1), 7)) == []
    store.append_hot(added(spark, 950, "2026-01-02 00:00:00"))
    (entry,) = opened_files(store, monkeypatch, lambda: migrate(store, NOW + timedelta(hours=2), 7))
    assert entry["file"].startswith("index=t1/") and entry["late_before"] == NOW - timedelta(days=7) + timedelta(hours=1)
    assert opened_files(store, monkeypatch, lambda: migrate(store, NOW + timedelta(hours=3), 7)) == []
    assert shown(store) == [*range(ALL), 950]


def test_late_rows_left_for_a_later_run(spark, store):
    migrate(store, NOW, 7)
    store.append_hot(added(spark, 951, "2026-01-02 00:00:00"))
    migrate(store, NOW, 7, late=False, delete_after=True)
    assert 951 in ids(store.hot()) and 951 not in ids(store.cold())
    migrate(store, NOW + timedelta(hours=1), 7, delete_after=True)
    assert 951 not in ids(store.hot()) and shown(store) == [*range(ALL), 951]


@pytest.mark.parametrize("table", ["hot_files", "run_metrics"])
def test_late_batch_lost_before_it_was_recorded(spark, store, monkeypatch, table):
    import tidemark.plans.migrate as job

    migrate(store, NOW, 7)
    store.append_hot(added(spark, 952, "2026-01-02 00:00:00").union(keyless(spark, "2026-01-03 00:00:00", "t2")))
    put = job.put_state

    def lost(rows, root, name):
        if name == table and "late" in "".join(f"{r}" for r in store.cold().select("batch").distinct().collect()):
            raise RuntimeError("driver lost")
        put(rows, root, name)

    with monkeypatch.context() as patch:
        patch.setattr(job, "put_state", lost)
        with pytest.raises(MigrationError):
            migrate(store, NOW, 7)
    migrate(store, NOW + timedelta(hours=1), 7)
    assert [i for i in ids(store.cold().where("event_id IS NOT NULL")) if i >= ALL] == [952]
    assert store.cold().where("event_id IS NULL").count() == 1
    late = get_state(spark, store.root, "run_metrics").where("metric_id LIKE '%-late'")
    assert {(r["index"], r.documents_migrated) for r in late.collect()} == {("t1", 1), ("t2", 1)}


def test_file_that_came_while_a_run_was_half_done(spark, store, monkeypatch):
    """Slices done before the file came lack its rows: it takes no part in the rest and is late as a whole."""
    import tidemark.plans.migrate as job

    counts = job.copied_counts

    def half(made, windows):
        return counts(made, windows).where("slice = 0")

    put = job.put_state

    def no_marks(rows, root, name):
        if name == "watermark":
            raise RuntimeError("driver lost")
        put(rows, root, name)

    with monkeypatch.context() as patch:
        patch.setattr(job, "copied_counts", half)
        patch.setattr(job, "put_state", no_marks)
        with pytest.raises(MigrationError):
            migrate(store, NOW, 7, slices=2)
    more = [added(spark, i, "2026-01-04 00:00:00") for i in range(1000, 1008)]
    for rows in more:
        store.append_hot(rows)
    migrate(store, NOW + timedelta(hours=5), 7, slices=2)
    assert shown(store) == [*range(ALL), *range(1000, 1008)]
    assert [i for i in ids(store.cold()) if i >= ALL] == list(range(1000, 1008))
    migrate(store, NOW + timedelta(hours=6), 7, delete_after=True)
    assert shown(store) == [*range(ALL), *range(1000, 1008)]


def test_store_from_before_the_ledger(spark, store):
    from tidemark.sources.files import remove

    migrate(store, NOW, 7)
    store.append_hot(added(spark, 953, "2026-01-02 00:00:00").union(keyless(spark, "2026-01-03 00:00:00")))
    remove(spark, f"{store.root}/state/hot_files")
    for hour in range(1, 3):
        migrate(store, NOW + timedelta(hours=hour), 7, delete_after=hour == 2)
        assert [i for i in ids(store.cold().where("event_id IS NOT NULL")) if i >= ALL] == [953]
        assert store.cold().where("event_id IS NULL").count() == 1
    assert store.cold().where("event_id < 240").count() == len(ids(store.cold().where("event_id < 240").distinct()))
