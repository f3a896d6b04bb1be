"""A tiered store: two Parquet tables and its state tables under one folder.

``hot``   partitioned by ``index``
``cold``  partitioned by ``index, batch, slice``; a slice of a run is what gets overwritten
``state`` high-water marks, purge marks, slice progress, run metrics
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.sources.files import append_rows, exists, finish_rewrite, make_folder, partition_values, read_table, remove
from tidemark.sources.state import get_state

HOT_PARTITIONS = ["index"]
COLD_PARTITIONS = ["index", "batch", "slice"]
# Batches of a packing: what is replaced, its folder in cold, the batch that replaces it, sizes and first place of its bins.
PACKING = "index STRING, batch STRING, folder STRING, into STRING, files BIGINT, bytes BIGINT, first_bin INT, bins INT"


@dataclass(frozen=True)
class TierStore:
    spark: SparkSession
    root: str
    columns: StructType  # of the rows, without partition columns
    key: str = "event_id"
    ts: str = "ts"

    @property
    def hot_path(self) -> str:
        return f"{self.root}/hot"

    @property
    def cold_path(self) -> str:
        return f"{self.root}/cold"

    @property
    def hot_schema(self) -> StructType:
        return StructType([*self.columns.fields, StructField("index", StringType())])

    @property
    def cold_schema(self) -> StructType:
        return StructType(
            [*self.hot_schema.fields, StructField("batch", StringType()), StructField("slice", IntegerType())]
        )

    def hot_names(self) -> DataFrame:
        """Names of the hot tables, one row each."""
        return self._names(self.hot_path)

    def cold_names(self) -> DataFrame:
        """Names of the cold tables, one row each."""
        return self._names(self.cold_path)

    def _names(self, path: str) -> DataFrame:
        names = partition_values(self.spark, path, "index")
        return self.spark.createDataFrame([(n,) for n in sorted(names)], "index STRING")

    def hot(self) -> DataFrame:
        return read_table(self.spark, self.hot_path, self.hot_schema)

    def cold(self) -> DataFrame:
        """Cold rows; a column added later is null in older files."""
        rows = read_table(self.spark, self.cold_path, self.cold_schema)
        if not exists(self.spark, f"{self.packing}/plan/_SUCCESS"):
            return rows
        hidden = self.hidden_batches().select("index", "hidden").withColumnRenamed("hidden", "batch").distinct()
        return rows.join(hidden, ["index", "batch"], "left_anti").select(*self.cold_schema.fieldNames())

    @property
    def packing(self) -> str:
        return f"{self.root}/packing"

    def hidden_batches(self) -> DataFrame:
        """Batches of an unfinished packing that are not to be read (``hidden``, in ``hidden_folder``).

        The new ones until the packing is committed, which is the last file of one small table; the old ones from then on.
        """
        plan = read_table(self.spark, f"{self.packing}/plan", PACKING)
        if exists(self.spark, f"{self.packing}/done/_SUCCESS"):
            return plan.withColumns({"hidden": F.col("batch"), "hidden_folder": F.col("folder")})
        new = F.concat(F.substring_index("folder", "/", 1), F.lit("/batch="), F.col("into"))
        return plan.withColumns({"hidden": F.col("into"), "hidden_folder": new})

    def finish_packing(self) -> None:
        """Delete the old files of a committed packing, or the new ones of one that was not. Can be repeated.

        Folders go one by one, named by the driver as a catalog drops partitions; no row is read. The plan goes
        before the commit: the other way round the new batches would be hidden again.
        """
        if exists(self.spark, f"{self.packing}/plan/_SUCCESS"):
            for row in self.hidden_batches().select("hidden_folder").distinct().toLocalIterator():
                remove(self.spark, f"{self.cold_path}/{row['hidden_folder']}")
        remove(self.spark, f"{self.packing}/plan")
        remove(self.spark, f"{self.packing}/done")

    def marks(self) -> DataFrame:
        return get_state(self.spark, self.root, "watermark")

    def append_hot(self, rows: DataFrame) -> None:
        append_rows(rows.select(*self.hot_schema.fieldNames()), self.hot_path, HOT_PARTITIONS)

    @property
    def purge_staging(self) -> str:
        return f"{self.root}/staging/purge"

    @property
    def retention_staging(self) -> str:
        return f"{self.root}/staging/retention"

    def prepare(self) -> None:
        """Make the folders and finish file replacements and packings a lost driver left half done."""
        for folder in (self.hot_path, self.cold_path):
            make_folder(self.spark, folder)
        finish_rewrite(self.spark, self.hot_path, self.purge_staging)
        finish_rewrite(self.spark, self.cold_path, self.retention_staging)
        self.finish_packing()
