"""Shared folders, written intermediate tables and partition removal."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_own_folders: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as Spark ships any module."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only where the session names none and runs within one process, as in tests, a folder
    of this machine is taken; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _own_folders[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    For control tables (one row per index or so): the plan that reads it knows its
    true size, so Spark broadcasts it when it is below its broadcast threshold and
    sort-merge joins it, with skew splitting, when it is not. Also cuts the lineage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop_conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(_hadoop_conf(spark))


def _decoded(spark: SparkSession, file_path: str):
    """Path of a file named by ``_metadata.file_path``, which is percent-encoded."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file_path))


def decoded_path(spark: SparkSession, folder: str, name: str) -> str:
    """Path to read of a file that ``file_name`` named, within the folder of its table."""
    return folder + spark._jvm.java.net.URI(name.replace(":", "%3A")).getPath()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.mkdirs(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)


def remove_files(spark: SparkSession, names: list[str]) -> None:
    """Delete files named as in ``inputFiles``; one that is gone already is no error."""
    for name in names:
        file = _decoded(spark, name)
        file.getFileSystem(_hadoop_conf(spark)).delete(file, False)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the Parquet files below a folder, from its listing; no file is opened."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    )
    return listed.select("path", F.col("length").alias("bytes"))


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the first partition column, from the names of the folders; no file is opened."""
    folder, fs = _path(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return [unquote(n.removeprefix(f"{column}=")) for n in names if n.startswith(f"{column}=")]


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet table; with a schema also one that holds no file yet."""
    if schema is None:
        return spark.read.option("mergeSchema", "true").parquet(path)
    make_folder(spark, path)
    return spark.read.schema(schema).parquet(path)


Flag = Callable[[DataFrame], DataFrame]


def file_name(file_path: Column) -> Column:
    """Folder and name of a file in a table with one partition column, as Spark names it in ``_metadata.file_path``."""
    return F.regexp_extract(file_path, "([^/]+/[^/]+)$", 1)


def table_files(rows: DataFrame) -> DataFrame:
    """(file, folder) of the files a table was read from; they were listed then, no file is opened."""
    names = [tuple(name.rsplit("/", 2)[1:]) for name in rows.inputFiles()]
    return rows.sparkSession.createDataFrame([(f"{a}/{b}", unquote(a)) for a, b in names], "file STRING, folder STRING")


def rewrite_keeping(
    spark: SparkSession, path: str, schema: StructType, partition_by: list[str], flag: Flag, staging: str,
    staged: Callable[[DataFrame], None] | None = None,
) -> None:
    """Remove rows of a partitioned table.

    ``flag`` narrows the table to the partitions to look at and adds a boolean
    ``_keep``. Files that lose every row are deleted; of files that lose some, the
    surviving rows are written to ``staging`` first and the file is replaced by them.
    Files nobody looked at, such as ones added meanwhile, are left alone. ``flag`` sees the file of each row as ``_file``;
    ``staged`` is told the new files (``table_files``) before they become part of the table.

    The list of files to replace is written last. From then on the step is finished by
    ``finish_rewrite``, also after a crash; before that it never happened.
    """
    finish_rewrite(spark, path, staging)
    with_file = read_table(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"))
    counts = flag(with_file).groupBy("_file").agg(
        F.count_if(F.col("_keep")).alias("_kept"), F.count_if(~F.col("_keep")).alias("_dropped")
    )
    replaced = settled(counts.where("_dropped > 0"), "files")
    # File names: table metadata, of which the driver holds all for any scan of the table.
    mixed = [_decoded(spark, row["_file"]).toString() for row in replaced.where("_kept > 0").toLocalIterator()]
    if mixed:
        rows = spark.read.schema(schema).option("basePath", path).parquet(*mixed)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"))
        survivors = flag(rows).where("_keep").select(*schema.fieldNames())
        survivors.write.partitionBy(*partition_by).parquet(f"{staging}/rows")
        if staged is not None:
            staged(table_files(spark.read.parquet(f"{staging}/rows")))
    replaced.select("_file").write.parquet(f"{staging}/files")
    finish_rewrite(spark, path, staging)


def finish_rewrite(spark: SparkSession, path: str, staging: str) -> None:
    """Carry out a completely staged rewrite; an incomplete one is discarded. Can be repeated.

    New files are moved in before old ones are deleted, so no row is ever missing.
    """
    if not exists(spark, f"{staging}/files/_SUCCESS"):
        remove(spark, staging)
        return
    if exists(spark, f"{staging}/rows"):
        source, fs = _path(spark, f"{staging}/rows")
        source = fs.resolvePath(source)
        found = fs.listFiles(source, True)
        while found.hasNext():
            staged = found.next().getPath()
            relative = source.toUri().relativize(staged.toUri()).getPath()
            if staged.getName().startswith("part-"):
                target, _ = _path(spark, f"{path}/{relative}")
                fs.mkdirs(target.getParent())
                if not fs.rename(staged, target):
                    raise OSError(f"could not move {staged} to {target}; the step is finished by a later run")
    for row in spark.read.parquet(f"{staging}/files").toLocalIterator():
        old = _decoded(spark, row["_file"])
        files = old.getFileSystem(_hadoop_conf(spark))
        if not files.delete(old, False) and files.exists(old):
            raise OSError(f"could not delete {old}; the step is finished by a later run")
    remove(spark, staging)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str], order: list[Column] | None = None) -> None:
    """Write a partitioned table, replacing just the partitions present in ``df``."""
    keys = [F.col(name) for name in partition_by]
    (
        df.sortWithinPartitions(*keys, *(order or []))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def append_rows(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Add rows to a partitioned table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
