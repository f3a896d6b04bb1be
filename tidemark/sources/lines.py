"""Line files: documents out, multi-search requests in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import split_names_column

# Messages of a multi-search file.
ODD_LINES = "msearch expects even number of lines"
EMPTY = "empty msearch"
LONG_LINE = "line too long"
# Characters that count as blank at the ends of a line.
BLANK = r"[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Blanks at either end; the look-behind keeps long runs of blanks within a line linear.
BLANK_ENDS = rf"\A{BLANK}++|(?<!{BLANK}){BLANK}++\z"


def trimmed(text: Column) -> Column:
    """Text without blanks at its ends; most lines have none, which two characters tell."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(F.rlike(ends, F.lit(BLANK)), F.regexp_replace(text, BLANK_ENDS, "")).otherwise(text)


def write_documents(documents: DataFrame, path: str, column: str | None = None, compress: bool = False) -> None:
    """One JSON document per line: the given text column as it is, else the whole row."""
    text = F.col(column) if column else F.to_json(F.struct("*"))
    writer = documents.select(text.alias("value")).write
    if compress:
        writer = writer.option("compression", "gzip")
    writer.text(path)


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Document files, as text column ``document`` or parsed by a schema."""
    if schema is not None:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).withColumnRenamed("value", "document")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as ``(file, chunk, position, text)``.

    A chunk is the part of a file one task reads and position rises within it, so lines
    of a file are ordered by (chunk, position) with no task seeing a whole file.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value").alias("text"),
    )


def numbered(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the non-blank lines of every file from 0.

    Lines are numbered within their chunk and shifted by the counts of the chunks before
    it, so a file of any length is spread over its chunks. Returns the lines with
    ``line`` and the files with ``(lines, longest)``, those of blank lines only too.
    """
    every = lines.withColumn("text", trimmed(F.col("text")))
    kept = every.where(F.col("text") != "")
    chunks = every.groupBy("file", "chunk").agg(
        F.count_if(F.col("text") != "").alias("n"), F.max(F.octet_length("text")).alias("longest")
    )
    files = chunks.groupBy("file").agg(F.sum("n").alias("lines"), F.max("longest").alias("longest"))
    offsets = chunks.selectExpr(
        "file", "chunk", "coalesce(sum(n) OVER (PARTITION BY file ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"
    )
    within = kept.selectExpr(
        "file", "chunk", "text", "row_number() OVER (PARTITION BY file, chunk ORDER BY position) - 1 AS at"
    )
    line = (F.col("at") + F.col("before")).alias("line")
    return within.join(offsets, ["file", "chunk"]).select("file", line, "text"), files


def msearch_entries(
    lines: DataFrame, default_indices: Sequence[str] = (), *, max_line_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pair header and body lines of multi-search files.

    Returns entries ``(file, entry, indices, body)`` of readable files, and one row per
    file ``(file, entries, error, passthrough)``: ``error`` when it is rejected as a
    whole, ``passthrough`` when an entry names no table or an internal one and so the
    whole file goes to hot. Lines may have any length, unless ``max_line_bytes`` rejects files with one that long.
    """
    rows, files = numbered(lines)
    too_long = F.lit(False) if max_line_bytes is None else F.col("longest") >= max_line_bytes
    error = (
        F.when(too_long, F.lit(LONG_LINE)).when(F.col("lines") % 2 != 0, F.lit(ODD_LINES)).when(F.col("lines") == 0, F.lit(EMPTY))
    )
    checked = files.select("file", "lines", error.alias("error"))

    is_header = F.col("line") % 2 == 0
    pairs = rows.groupBy("file", F.expr("line div 2").alias("entry")).agg(
        F.max(F.when(is_header, F.col("text"))).alias("header"), F.max(F.when(~is_header, F.col("text"))).alias("body")
    )
    member = F.try_variant_get(F.try_parse_json("header"), "$.index", "variant")
    named = F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(member, "$", "string"))
    defaults = F.array(*[F.lit(n) for n in default_indices]).cast("array<string>")
    indices = F.when(named != "", split_names_column(named)).otherwise(defaults)
    entries = pairs.join(checked.where("error IS NULL").select("file"), "file", "left_semi").select(
        "file", "entry", indices.alias("indices"), "body"
    )
    unroutable = (F.size("indices") == 0) | F.exists("indices", lambda n: n.startswith("."))
    flags = entries.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.bool_or(unroutable).alias("passthrough"))
    report = checked.join(flags, "file", "left").select(
        "file",
        F.coalesce("entries", F.lit(0)).alias("entries"),
        "error",
        F.coalesce("passthrough", F.lit(False)).alias("passthrough"),
    )
    return entries, report
