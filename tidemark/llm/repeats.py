"""Removal of strings that occur more than once, judged by suffix arrays of what may be equal.

Every window of ``width`` bytes has one anchor: the leftmost of its least ``GRAM``-byte strings by hash. Equal windows
have equal anchors at equal distances, so windows are compared only where the strings at their anchors agree.
Windows of one anchor are consecutive; together they are its stretch of text. Then

1. anchors are counted by their string; only anchors that occur again go on;
2. where all stretches around an anchor are the same, each of their windows occurs again;
3. where they differ, the distinct stretches are gathered and their suffix arrays, built by linear
   grouping, tell which windows occur in two of them;
4. an anchor with more distinct stretches than a task should hold has its windows counted one by one.

The text is shuffled once; documents without any anchor that occurs again leave only their digest there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.suffixes import suffix_order
from tidemark.llm.texts import documents, kept, merged_spans, pair_hash, row_key, segments, slices

WIDTH = 200
GRAM = 64
#: Distinct stretches of an anchor that are sorted together.
MOST_STRETCHES = 2048
#: Symbols of the suffix arrays of one step.
STEP_SYMBOLS = 1 << 20


def _chunk_hashes(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of the bytes at each place, by ascending length (8 at least), of halves that may overlap."""
    wide = data.astype(np.uint64)
    for step in (1, 2, 4):
        wide = wide[:-step] | wide[step:] << np.uint64(8 * step)
    have, out = 8, []
    for length in lengths:
        while have < length:
            step = min(have, length - have)
            wide = pair_hash(wide[:-step], wide[step:])
            have += step
        out.append(wide)
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH):
    """Stretches of each document: document, first and last window, anchor, its hash, the stretch's hash.

    Places are within ``data``. A stretch is known by its first and last window, which cover it, and
    by the anchor's place in it.
    """
    n = len(data) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    gram = min(GRAM, width)
    grams, whole = _chunk_hashes(data, gram, width)
    ranked = (grams >> np.uint64(32)) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    span, least = 1, ranked
    grams_of_window = width - gram + 1
    while span < grams_of_window:
        step = min(span, grams_of_window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    least = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.maximum(ends - starts - width + 1, 0)
    window = np.repeat(starts, size) + segments(size)
    doc = np.repeat(np.arange(len(starts)), size)
    if not len(window):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    anchor = least[window]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(window)) - 1
    low, high, at = window[first], window[last], anchor[first]
    shape = ((at - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64)
    return doc[first], low, high, at, grams[at], pair_hash(pair_hash(whole[low], whole[high]), shape)


def _stretches(width: int):
    def stretches(batches):
        for part in slices(batches):
            doc, low, high, _, key, stretch = anchors(part.data, part.starts, part.ends, width)
            yield pa.RecordBatch.from_pydict({
                "row_key": part.column("row_key").take(pa.array(doc)), "low": pa.array(low - part.starts[doc], pa.int64()),
                "span": pa.array(high - low, pa.int32()), "key": pa.array(key.view(np.int64)),
                "stretch": pa.array(stretch.view(np.int64)),
            })

    return stretches


_STRETCH = "row_key long, low long, span int, key long, stretch long"


def _cut(width: int):
    """Bytes of chosen stretches of each text."""

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, chosen = row["text"].encode(), row["chosen"]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([c["key"] for c in chosen], pa.int64()),
                    "stretch": pa.array([c["stretch"] for c in chosen], pa.int64()),
                    "times": pa.array([c["times"] for c in chosen], pa.int64()),
                    "peers": pa.array([c["peers"] for c in chosen], pa.int64()),
                    "body": pa.array([raw[c["low"] : c["low"] + c["span"] + width] for c in chosen], pa.binary()),
                })

    return cut


def repeated_starts(keys: np.ndarray, bodies: list[bytes], width: int) -> list[np.ndarray]:
    """Per string the windows' starts that occur again, in it or in another string of its key.

    Strings of a key lie together. Their suffix arrays are built in one go; equal windows are
    neighbours among the suffixes that are long enough.
    """
    lengths = np.array([len(b) for b in bodies], dtype=np.int64)
    # Each string is followed by a 1, the last one of a key by a 0.
    closes = np.append(keys[1:] != keys[:-1], True)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    symbols = np.ones(int(ends[-1]), dtype=np.int64)
    symbols[ends[closes] - 1] = 0
    inside = np.repeat(starts, lengths) + segments(lengths)
    raw = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    symbols[inside] = raw.astype(np.int64) + 2
    base = starts[np.append(True, closes[:-1])]
    order = suffix_order(symbols, base, np.diff(np.append(base, len(symbols))))
    owner = np.repeat(np.arange(len(bodies)), lengths + 1)
    start = order[ends[owner[order]] - 1 - order >= width]
    one, two = start[:-1], start[1:]
    same_key = keys[owner[one]] == keys[owner[two]]
    one, two = one[same_key], two[same_key]
    (window,) = _chunk_hashes(symbols, width)
    equal = window[one] == window[two]
    again = np.unique(np.concatenate([one[equal], two[equal]]))
    whose = owner[again]
    cut = np.searchsorted(whose, np.arange(len(bodies) + 1))
    return [again[cut[i] : cut[i + 1]] - starts[i] for i in range(len(bodies))]


def _runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive places."""
    if not len(places):
        return [], []
    breaks = np.flatnonzero(np.diff(places) != 1)
    return places[np.append(0, breaks + 1)].tolist(), places[np.append(breaks, len(places) - 1)].tolist()


def _judge(width: int):
    """Rows come sorted by peers and key; whole keys are judged together, some at a time."""

    def judge(batches):
        keys, stretches, times, bodies, size = [], [], [], [], 0

        def result():
            found = repeated_starts(np.array(keys), bodies, width)
            rows = []
            for s, k, n, body, places in zip(stretches, keys, times, bodies, found):
                runs = ([0], [len(body) - width]) if n > 1 else _runs(places)
                rows += [(k, s, a, b) for a, b in zip(*runs)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["key", "stretch", "first", "last"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if size >= STEP_SYMBOLS and row["key"] != keys[-1]:
                    yield result()
                    keys, stretches, times, bodies, size = [], [], [], [], 0
                keys.append(row["key"])
                stretches.append(row["stretch"])
                times.append(row["times"])
                bodies.append(row["body"])
                size += len(row["body"]) + 1
        if keys:
            yield result()

    return judge


def _windows(width: int):
    """Every window of a stretch by its hash, for anchors with very many stretches."""

    def windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (found,) = _chunk_hashes(np.frombuffer(row["body"], dtype=np.uint8), width)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([row["key"]] * len(found), pa.int64()), "stretch": pa.array([row["stretch"]] * len(found), pa.int64()),
                    "times": pa.array([row["times"]] * len(found), pa.int64()), "first": pa.array(np.arange(len(found)), pa.int64()),
                    "window": pa.array(found.view(np.int64)),
                })

    return windows


def _remove(width: int):
    def remove(batches):
        for part in slices(batches):
            raw = part.data.tobytes()
            spans = part.column("spans").to_pylist()
            n_removed, n_spans, digest, left = [], [], [], []
            for start, end, own in zip(part.starts.tolist(), part.ends.tolist(), spans):
                own = own or []
                b, e = merged_spans(
                    np.array([s["first"] for s in own], np.int64), np.array([s["last"] + width for s in own], np.int64)
                )
                text = raw[start:end]
                edges = [0, *np.stack([b, e], 1).ravel().tolist(), len(text)]
                rest = b"".join(text[x:y] for x, y in zip(edges[0::2], edges[1::2]))
                n_removed.append(len(text) - len(rest))
                n_spans.append(len(b))
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_bytes": pa.array(part.ends - part.starts, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(left, pa.binary()),
            })

    return remove


def remove_repeats(
    docs: DataFrame, *, width: int = WIDTH, doc_id="doc_id", text="text", most_stretches: int = MOST_STRETCHES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes, null for texts that stay whole).

    Every byte that a string of ``width`` bytes covers which also begins elsewhere, in the same document
    or another, is removed; strings are judged on the texts as given and may overlap. A null text is an
    empty one; texts shorter than ``width`` stay. Rows that repeat are documents of their own: if long enough
    they lose all their text. Other columns are dropped.
    """
    rows = documents(docs, doc_id=doc_id, text=text).select("*", row_key("doc_id", "text"))
    found = kept(rows.select("row_key", "text").mapInArrow(_stretches(width), _STRETCH), "anchors")
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
    again = kept(counted.where("n > 1").select("key", (F.col("a") == F.col("b")).alias("alike")), "again")
    repeats = kept(found.join(again, "key"), "stretches")

    by_row = repeats.groupBy("row_key").agg(
        F.collect_list(F.when(F.col("alike"), F.struct(F.col("low").alias("first"), (F.col("low") + F.col("span")).alias("last")))).alias("spans")
    )
    # Texts that no anchor names are needed no more; their digest is taken on the way.
    joined = kept(rows.join(by_row, "row_key", "left").select(
        "doc_id", "row_key", "spans", F.when(F.col("spans").isNotNull(), F.col("text")).alias("text"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.when(F.col("spans").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("kept_sha256"),
    ), "texts")

    place = F.struct("row_key", "low", "span")
    distinct = repeats.where("NOT alike").groupBy("key", "stretch").agg(F.count("*").alias("times"), F.min(place).alias("at"))
    distinct = kept(distinct.select("key", "stretch", "times", "at.*"), "distinct")
    per_key = distinct.groupBy("key").agg(F.count("*").alias("peers"))
    chosen = distinct.join(per_key, "key").groupBy("row_key").agg(
        F.collect_list(F.struct("key", "stretch", "times", "peers", "low", "span")).alias("chosen")
    )
    texts = joined.where("spans IS NOT NULL").select("row_key", "text").dropDuplicates(["row_key"])
    bodies = kept(
        texts.join(chosen, "row_key").select("text", "chosen")
        .mapInArrow(_cut(width), "key long, stretch long, times long, peers long, body binary"),
        "bodies",
    )
    # Keys of like size are judged together: their suffix arrays take as many steps.
    few = bodies.where(F.col("peers") <= most_stretches).repartition("key").sortWithinPartitions("peers", "key")
    judged = few.mapInArrow(_judge(width), "key long, stretch long, first long, last long")
    single = bodies.where(F.col("peers") > most_stretches).select("key", "stretch", "times", "body").mapInArrow(
        _windows(width), "key long, stretch long, times long, first long, window long"
    )
    often = single.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    counted_one = single.join(often, "window").select("key", "stretch", "first", F.col("first").alias("last"))
    differing = repeats.where("NOT alike").select("row_key", "low", "key", "stretch")
    more = differing.join(judged.union(counted_one), ["key", "stretch"]).groupBy("row_key").agg(
        F.collect_list(F.struct((F.col("low") + F.col("first")).alias("first"), (F.col("low") + F.col("last")).alias("last"))).alias("more")
    )
    affected = joined.where("spans IS NOT NULL").join(more, "row_key", "left").select(
        "doc_id", "text", F.concat("spans", F.coalesce("more", F.expr("CAST(array() AS array<struct<first:long,last:long>>)"))).alias("spans")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    removed = affected.mapInArrow(
        _remove(width), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    none = F.lit(0).cast("long")
    whole = joined.where("spans IS NULL").select(
        "doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept")
    )
    return removed.unionByName(whole)
