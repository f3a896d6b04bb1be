"""Token ids of whole texts, written as wavelet matrices and read back from them.

Documents are put in ascending order by a range shuffle; each task then writes one
compressed file of blocks. A block is a wavelet matrix over the tokens of some consecutive
documents: one bit plane per bit of an id, with a count of ones every 512 bits, from which access,
counting and occurrence lookup are answered without unpacking the text.
"""

from __future__ import annotations

import re
import struct
import zlib
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import Memo, documents, kept, segments, ship, slices

#: Tokens of a block, unless one document alone has more; bounds the memory of a task.
BLOCK_TOKENS = 1 << 20
SUPER = 512
#: Bytes of words and their ids that a worker remembers.
MEMO_BYTES = 192 << 20

SHARD_SCHEMA = (
    "part int, block int, n_tokens long, width int, zeros array<long>, planes array<binary>, ranks array<binary>,"
    " doc_ids array<long>, doc_tokens array<long>"
)

_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Small Latin letters, digits and ASCII marks but the apostrophe, and the matches of the tokenizer's pattern in such words.
_PLAIN = re.compile("[!-&(-@[-~ß-öø-ÿ]+")
_MATCHES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")
#: ASCII marks that may be cut off the end of a word before it is encoded.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WaveletMatrix:
    """Bit planes from the highest bit down; each plane is stably parted into zeros and ones."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        row, zeros, planes, ranks = ids, [], [], []
        for level in range(width - 1, -1, -1):
            bit = row & ids.dtype.type(1 << level) != 0
            packed = np.packbits(bit, bitorder="little")
            whole = np.zeros(-(-len(packed) // (SUPER // 8)) * (SUPER // 8), dtype=np.uint8)
            whole[: len(packed)] = packed
            ones = np.cumsum(np.bitwise_count(whole.view(np.uint64)).reshape(-1, SUPER // 64).sum(axis=1, dtype=np.int64))
            planes.append(packed)
            ranks.append(np.concatenate([[0], ones[:-1]])[: len(ones)].astype(np.uint32))
            zeros.append(len(row) - int(ones[-1]) if len(ones) else 0)
            parted = np.empty_like(row)
            # Places first: a mask over the ids themselves is slower.
            np.take(row, np.flatnonzero(~bit), out=parted[: zeros[-1]], mode="clip")
            np.take(row, np.flatnonzero(bit), out=parted[zeros[-1] :], mode="clip")
            row = parted
        return cls(len(ids), zeros, planes, ranks)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position, from the stored counts and at most one block of bits."""
        at = np.asarray(at, dtype=np.int64)
        if not self.n:
            return np.zeros_like(at)
        plane = self.planes[level]
        base = np.minimum(at // SUPER, len(self.ranks[level]) - 1)
        count = self.ranks[level][base].astype(np.int64)
        first, bits = base * (SUPER // 8), at - base * SUPER
        for k in range(SUPER // 8):
            take = bits - 8 * k
            if not (take > 0).any():
                break
            byte = plane[np.minimum(first + k, len(plane) - 1)]
            mask = (1 << np.clip(take, 0, 8)) - 1
            count += np.bitwise_count(byte.astype(np.int64) & mask)
        return count

    def access(self, at) -> np.ndarray:
        """The tokens at these places."""
        at = np.asarray(at, dtype=np.int64)
        value = np.zeros(len(at), dtype=np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[at >> 3] >> (at & 7)) & 1
            ones = self._rank1(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            value = value << 1 | bit
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        width = len(self.planes)
        for level in range(width):
            ones = self._rank1(level, np.array([begin, end]))
            if token >> (width - 1 - level) & 1:
                begin, end = (int(x) + self.zeros[level] for x in ones)
            else:
                begin, end = int(begin - ones[0]), int(end - ones[1])
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in a range."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, begin, self.n if end is None else end)
        return high - low

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token: its range in the last plane, traced back up."""
        if token >> len(self.planes):
            return np.zeros(0, np.int64)
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high, dtype=np.int64)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            one = at >= self.zeros[level]
            at = np.where(one, self._select(bits, 1, at - self.zeros[level]), self._select(bits, 0, at))
        return np.sort(at)

    @staticmethod
    def _select(bits: np.ndarray, value: int, nth: np.ndarray) -> np.ndarray:
        where = np.flatnonzero(bits == value)
        return where[np.clip(nth, 0, max(0, len(where) - 1))] if len(where) else nth

    def decode(self) -> np.ndarray:
        """All tokens in order: the partings of the planes are undone from the last one up."""
        width = len(self.planes)
        value = np.zeros(self.n, dtype=np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(value)
            above[np.flatnonzero(~bit)] = value[: self.zeros[level]]
            above[np.flatnonzero(bit)] = value[self.zeros[level] :] | value.dtype.type(1 << (width - 1 - level))
            value = above
        return value.astype(np.uint32)


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _little_endian(ids: list[int]) -> bytes:
    """As 32-bit integers; for a few ids quicker than an array of numpy."""
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordCoder:
    """Ids of texts by a tokenizer that drops white space and never joins across it.

    Texts are cut at spaces and line feeds and a distinct word is encoded once while it is remembered. A word of small Latin
    letters, digits and ASCII marks is encoded by the matches of the tokenizer's own pattern: runs of letters, single digits,
    runs of marks. Any other that ends in ASCII marks after a letter or digit is encoded in two parts, as a
    match ends there. A part of small Latin letters is one match that normalising leaves alone, so it goes to the model.
    What is remembered is bounded and serves all tasks of a worker. A text of Latin-1 characters is lower-cased whole: the
    tokenizer does that to each of them alone, and composes none of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        spelling = list(map(chr, range(256)))  # by byte of UTF-8; of all above ASCII only those of small Latin letters are asked for
        for c in range(0xDF, 0x100):
            for byte, letter in zip(chr(c).encode(), spelled(chr(c))[0][0], strict=True):
                spelling[byte] = letter
        self.spelling = "".join(spelling)
        self.words = Memo(self._word, MEMO_BYTES)
        self.top = self.tokenizer.get_vocab_size(with_added_tokens=True) - 1

    def _word(self, word: str) -> bytes:
        if _LETTERS.fullmatch(word):
            spelled = word if word.isascii() else charmap_decode(word.encode(), "strict", self.spelling)[0]
            return _little_endian([t.id for t in self.split(spelled)])
        # A special token such as <|name|> ends in marks and has to stay whole.
        if "<|" not in word:
            if _PLAIN.fullmatch(word) and len(matches := _MATCHES.findall(word)) > 1:
                return b"".join(map(self.words.__getitem__, matches))
            head = word.rstrip(_MARKS)
            if head and len(head) < len(word) and (head[-1].isalpha() or head[-1].isnumeric()):
                return self.words[head] + self.words[word[len(head) :]]
            if word.isascii() and (small := word.lower()) != word:
                return self.words[small]
        return _little_endian(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text and _is_latin(text):
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def _block(part: int, number: int, width: int, ids: list[bytes], doc_ids: list) -> pa.RecordBatch:
    tokens = np.frombuffer(b"".join(ids), dtype="<u4")
    matrix = WaveletMatrix.build(tokens.astype(np.uint16) if width <= 16 else tokens, width)
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()),
        "n_tokens": pa.array([matrix.n], pa.int64()), "width": pa.array([width], pa.int32()),
        "zeros": pa.array([matrix.zeros], pa.list_(pa.int64())),
        "planes": pa.array([[p.tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
        "ranks": pa.array([[r.astype("<u4").tobytes() for r in matrix.ranks]], pa.list_(pa.binary())),
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
        "doc_tokens": pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())),
    })


def _encode(path: str, end_id: int, block_tokens: int):
    def encode(batches):
        coder, part, number = word_coder(path), TaskContext.get().partitionId(), 0
        width = max(1, int(max(coder.top, end_id)).bit_length())
        closing = np.array([end_id], dtype="<u4").tobytes()
        ids, doc_ids, size = [], [], 0
        for piece in slices(batches):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                own = coder.encode(text) + closing
                if ids and size + len(own) > 4 * block_tokens:
                    yield _block(part, number, width, ids, doc_ids)
                    ids, doc_ids, size, number = [], [], 0, number + 1
                ids.append(own)
                doc_ids.append(doc_id)
                size += len(own)
        if ids:
            yield _block(part, number, width, ids, doc_ids)

    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int, doc_id="doc_id", text="text",
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write the ids of every whole text, ``end_id`` after each, in ascending doc_id order.

    A null or empty text is just ``end_id``. Null doc_ids come first; rows that repeat a doc_id are all
    written, in order of the hash of their text. Other columns are dropped.
    """
    rows = documents(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ordered.mapInArrow(_encode(tokenizer, end_id, block_tokens), SHARD_SCHEMA)
    blocks.write.option("compression", "zstd").parquet(path)


def matrix_of(width: int, n: int, zeros, planes, ranks) -> WaveletMatrix:
    return WaveletMatrix(
        n, list(zeros), [np.frombuffer(p, np.uint8) for p in planes], [np.frombuffer(r, "<u4") for r in ranks]
    )


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            matrix = matrix_of(row["width"], row["n_tokens"], row["zeros"], row["planes"], row["ranks"])
            raw, lengths = matrix.decode().astype("<u4").tobytes(), np.array(row["doc_tokens"], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(lengths)])
            first = at[:-1] + row["before"]
            ids = [raw[4 * b : 4 * e] for b, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(first, pa.int64()),
                "n_tokens": pa.array(lengths, pa.int64()), "ids": pa.array(ids, pa.binary()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            })


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids (little-endian 32-bit), ids_crc32."""
    ship(spark)
    blocks = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row per task that wrote; blocks before that in the task are summed within it.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block")
    sizes = blocks.select("part", "block", "n_tokens")
    starts = sizes.select("part", "block", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("within"))
    known = starts.join(offsets, "part").select("part", "block", (F.col("within") + F.col("part_start")).alias("before"))
    # Written first, so that its size is known and the blocks need no shuffle while it is small.
    known = kept(known, "starts")
    rows = blocks.join(known, ["part", "block"]).select(
        "n_tokens", "width", "zeros", "planes", "ranks", "doc_ids", "doc_tokens", "before"
    )
    return rows.mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
