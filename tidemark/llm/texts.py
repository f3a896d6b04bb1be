"""Arrow batches of texts as flat byte arrays, hashes over them, and bounded memos.

Everything works on slices of about a megabyte, so a task holds a slice and its hashes,
whatever its partition holds; one text longer than that is a slice of its own. Batches are bounded by bytes as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.files import remove, shared_folder, ship  # noqa: F401

SLICE_BYTES = 1 << 20
#: Bytes of a batch, which Spark and a Python worker both hold whole.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Have Spark cut the batches for Python by bytes; by itself it cuts them at 10,000 rows, however long."""
    if int(spark.conf.get(_BATCH).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@dataclass
class Slice:
    """Some rows of a batch; document i is ``data[starts[i]:ends[i]]``."""

    rows: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches by bytes of text; a null text is an empty one."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        if len(texts) == 0:
            continue
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            last = min(last, len(texts))
            at = offsets[first : last + 1]
            yield Slice(
                batch.slice(first, last - first), data[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]
            )
            first = last


def row_key(*columns: str) -> Column:
    """A key of a row's content: rows that repeat share it, so joins by it give each its result."""
    return F.xxhash64(*[F.col(c) for c in columns]).alias("row_key")


def documents(docs: DataFrame, *columns: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the named columns, under plain names; other columns cannot clash with what is added."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c) for c in columns])


def packed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, and all columns but the text as the one column ``row``, safe from clashing names."""
    rest = [F.col(c) for c in docs.columns if c != text]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*rest).alias("row"))


def unpacked(found: DataFrame, columns: list[str], *, text: str = "text", **changed: Column) -> DataFrame:
    """The columns as they were before ``packed``, but the text and those in ``changed``."""
    return found.select(*[
        F.col("text").alias(c) if c == text else changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c)
        for c in columns
    ])


#: Removes the files of its shuffles when a step has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, survives lost executors.

    What was shuffled for it is removed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    schema = StructType.fromJson(df.schema.jsonValue())
    table = spark.read.schema(schema).parquet(path)
    table.kept_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``kept`` wrote and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.kept_path)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two halves, from their hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xD6E8FEB86659FD93)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, any other byte as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray):
    """Maximal runs of bytes flagged in the table ``inside``, which never cross documents.

    Returns begin, end and document of each word, in order.
    """
    flag = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[:-1] = flag
    edge[1:] ^= flag
    if len(data) and not flag[0]:
        edge[0] = False
    edge[len(data)] = bool(len(data)) and bool(flag[-1])
    # A word that touches the start of a document is cut there.
    cut = starts[(starts > 0) & (starts < len(data))]
    cut = np.unique(cut)
    both = cut[flag[cut] & flag[cut - 1]] if len(cut) else cut
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    begin, end = at[0::2], at[1::2]
    # Documents without text share their start with the next one: the last of them owns the word.
    doc = np.searchsorted(starts, begin, side="right") - 1
    return begin, end, doc


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1 to n of an odd number modulo 2 ** 64, and powers 0 to n - 1 of its inverse."""
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    inverse[:1] = 1
    return np.cumprod(np.full(n, _BASE, dtype=np.uint64)), np.cumprod(inverse)


_usual_powers = lru_cache(maxsize=1)(_powers)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from its bytes only."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = (end - begin).astype(np.int64)
    power, inverse = _usual_powers(2 * SLICE_BYTES) if len(data) <= 2 * SLICE_BYTES else _powers(len(data))
    # The sum of (byte + 1) * power over a word, from sums over all that is before; these wrap around and cancel out.
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    value = (sums[end] - sums[begin]) * inverse[begin]
    return mix(value ^ (length.astype(np.uint64) << np.uint64(56)))


class Memo(dict):
    """Results by word, of about ``limit`` bytes at most, entries included.

    When half of that is held, it becomes the older half and the one before it goes; a word of the older half that comes
    again is taken over, so frequent words stay.
    """

    ENTRY = 200  # bytes of an entry beside its word and result

    def __init__(self, compute, limit: int = 48 << 20):
        super().__init__()
        self.compute, self.limit, self.held, self.older = compute, limit, 0, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        self.held += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.held > self.limit // 2:
            self.older = dict(self)
            super().clear()
            self.held = 0
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.held, self.older = 0, {}


def segments(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of several runs of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def merged_spans(begin: np.ndarray, end: np.ndarray):
    """Union of spans, as maximal ones; touching spans become one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], begin[1:] > reach[:-1]])
    last = np.concatenate([first[1:], [True]])
    return begin[first], reach[last]


def text_list(batch: Slice, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()
