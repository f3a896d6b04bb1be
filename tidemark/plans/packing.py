"""Packing: small files of cold into large ones, logs of state into short ones.

Every run adds a partition per table and slice to cold, so tables with few rows a run come to consist of small files.
A packing takes the finished batches made of small files, lays them end to end by recorded size, cuts that line into
bins of the target size and writes each bin as one file of a new batch. Only those batches are read; rows go through one shuffle, by bin.

What is visible changes at one point, the commit of a table of counts: before it readers see the old batches, after it the new one
(``TierStore.cold``). A packing that broke off is undone or finished by the next job on the store (``TierStore.prepare``).
Readers that listed their files before old ones are deleted fail and have to start again, as with a purge.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.migrate import batch_name
from tidemark.plans.store import COLD_PARTITIONS, PACKING, TierStore
from tidemark.sources.files import file_sizes, overwrite_partitions, read_table
from tidemark.sources.state import KEYS, fold_state, get_state, open_slices

TARGET_BYTES = 256 << 20


def cold_batches(store: TierStore) -> DataFrame:
    """(index, batch, folder, files, bytes) of cold, from the listing of its files."""
    folder = F.regexp_extract("path", "([^/]+/[^/]+)/[^/]+/[^/]+$", 1)
    sizes = file_sizes(store.spark, store.cold_path).groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )
    name, batch = F.regexp_extract("folder", "^index=(.*)/", 1), F.regexp_extract("folder", "/batch=(.*)$", 1)
    # A plus sign stands for itself in the name of a folder.
    return sizes.withColumns(
        {"index": F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "batch": batch}
    ).where(F.regexp_like("folder", F.lit("^index=.*/batch=")) & (name != "__HIVE_DEFAULT_PARTITION__"))


def unfinished_batches(store: TierStore) -> DataFrame:
    """(index, batch) that a later run may still write to."""
    runs = open_slices(get_state(store.spark, store.root, "slice_state"), store.marks())
    late = get_state(store.spark, store.root, "hot_files").where("NOT done AND batch IS NOT NULL")
    return runs.select("index", batch_name(F.col("cutoff_time")).alias("batch")).union(late.select("index", "batch")).distinct()


def packing_plan(store: TierStore, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The batches to pack, and the bins their rows go to.

    A batch is small if its files are below half the target on average. A table is packed if that at least halves
    the files of its small batches, so that what was packed is left alone until enough has come in. A batch as large as several
    bins is dealt to that many; a bin holds parts of less than three times the target.
    """
    small = (
        cold_batches(store).where(F.col("bytes") * 2 < F.col("files") * F.lit(target_bytes))
        .join(unfinished_batches(store), ["index", "batch"], "left_anti")
    )
    line = Window.partitionBy("index").orderBy("batch")
    before = F.sum("bytes").over(line) - F.col("bytes")
    placed = small.withColumns(
        {
            "first_bin": F.floor(before / target_bytes).cast("int"),
            "bins": F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1)).cast("int"),
        }
    )
    table = Window.partitionBy("index")
    gain = F.sum("files").over(table) >= 2 * F.max(F.col("first_bin") + F.col("bins")).over(table)
    into = F.lit(f"pack{uuid.uuid4().hex}")
    chosen = placed.withColumn("_gain", gain).where("_gain").withColumn("into", into)
    columns = [field.split(" ")[0] for field in PACKING.split(", ")]
    return chosen.select(*[F.col(name) for name in columns])


def rows_in(store: TierStore, folders: DataFrame) -> DataFrame:
    """Rows of some folders of cold; the driver holds their names, as it does for any scan."""
    paths = [f"{store.cold_path}/{row[0]}" for row in folders.distinct().toLocalIterator()]
    return store.spark.read.schema(store.cold_schema).option("basePath", store.cold_path).parquet(*paths)


def packed_rows(store: TierStore, plan: DataFrame) -> DataFrame:
    """The rows of the planned batches in their new place.

    A row's bin within its batch is a hash of its file and place in it: a repeated task deals it alike, and equal rows
    or rows without a key are dealt evenly.
    """
    rows = rows_in(store, plan.select("folder"))
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    rows = rows.withColumn("_place", place).join(plan.select("index", "batch", "into", "first_bin", "bins"), ["index", "batch"])
    return rows.withColumns(
        {"batch": F.col("into"), "slice": (F.col("first_bin") + F.pmod("_place", F.col("bins"))).cast("int")}
    ).select(*store.cold_schema.fieldNames())


def pack_cold(store: TierStore, target_bytes: int = TARGET_BYTES) -> int:
    """Replace small files of cold by large ones; returns how many were replaced.

    The rows are those there were before, in a new batch per table, ordered by time within a file. One writer at a time.
    """
    store.prepare()
    packing_plan(store, target_bytes).coalesce(1).write.mode("overwrite").parquet(f"{store.packing}/plan")
    plan = read_table(store.spark, f"{store.packing}/plan", PACKING)
    files = plan.agg(F.sum("files").alias("files")).first()["files"]
    if files:
        rows = packed_rows(store, plan).repartition("index", "batch", "slice")
        overwrite_partitions(rows, store.cold_path, COLD_PARTITIONS, [F.col(store.ts)])
        commit(store, plan)
    store.finish_packing()
    return files or 0


def commit(store: TierStore, plan: DataFrame) -> None:
    """Make the new batches the visible ones, if they hold as many rows of each table as the old ones."""
    old, new = rows_in(store, plan.select("folder")), rows_in(store, store.hidden_batches().select("hidden_folder"))
    counts = [rows.groupBy("index").agg(F.count(F.lit(1)).alias(name)) for rows, name in ((old, "held"), (new, "rows"))]
    totals = counts[0].join(counts[1], "index", "full")
    wrong = F.raise_error(F.concat(F.lit("packing changed the number of rows of "), F.col("index")))
    checked = totals.select("index", F.when(F.equal_null("rows", "held"), F.col("rows")).otherwise(wrong).alias("rows"))
    checked.write.mode("overwrite").parquet(f"{store.packing}/done")


def fold_states(store: TierStore) -> None:
    """Shorten all logs of the store to what is read from them."""
    for table in KEYS:
        fold_state(store.spark, store.root, table)
