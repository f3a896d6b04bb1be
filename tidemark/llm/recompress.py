"""Removal of word passages that occur earlier, found by recompression.

Each text is parsed in rounds. The first names runs of equal words, every further one names pairs: a symbol is
left or right by a bit of its name, and a left one joins the right one behind it. A name is a hash of the two names
it stands for, so all tasks name alike without a dictionary. What a window of ``width`` words is
parsed to depends on nothing outside it, but for the symbols at its two ends, which are taken off in each round.
The rest is its core: equal windows have equal cores at equal places. The anchor of a window is the best symbol of its
highest core, and neighbouring windows share it; together they are a stretch of words. Then, in Spark rounds,

1. symbols that are the anchor of one stretch only are dropped: their windows are unique;
2. equal stretches are told by anchor and content: all but the first one are removed;
3. where an anchor has different stretches, the windows of the first one of each are compared one by one.

What decides is equality of the anchor's name together with that of a stretch (64 bits each), and of windows by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import documents, forget, kept, mix, pair_hash, row_key, segments, slices, word_hashes, words

WIDTH = 20
#: Rounds that name pairs, after the one that names runs.
PAIR_ROUNDS = 3
#: A symbol of so many words is taken as an anchor before any shorter one.
LONG_SYMBOL = 3
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def named_runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names after runs of equal symbols became one; and the new symbol of each old one."""
    new = np.append(True, names[1:] != names[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    return np.where(length > 1, pair_hash(names[at], length), names[at]), np.cumsum(new) - 1


def is_right(names: np.ndarray, level: int) -> np.ndarray:
    return mix(names + np.uint64(level)) >> np.uint64(63) == 1


def named_pairs(names: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names after each left symbol joined a right one behind it; and the new symbol of each old one."""
    joins = np.append(False, right[1:] & ~right[:-1])
    at = np.flatnonzero(~joins)
    merged = names[at].copy()
    pairs = np.flatnonzero(joins)
    place = np.cumsum(~joins) - 1
    merged[place[pairs]] = pair_hash(names[pairs - 1], names[pairs])
    return merged, place


def best_symbols(low: np.ndarray, high: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each range of symbols the one of least rank, the first of equal ones."""
    rank = (mix(names) >> np.uint64(1)) | ((sizes < LONG_SYMBOL).astype(np.uint64) << np.uint64(63))
    best, value = low.copy(), rank[low]
    more = np.flatnonzero(high - low > 1)
    step = 1
    while len(more):
        at = low[more] + step
        found = rank[at]
        better = found < value[more]
        best[more[better]] = at[better]
        value[more[better]] = found[better]
        step += 1
        more = more[high[more] - low[more] > step]
    return best


def anchors(names: np.ndarray, start: np.ndarray, width: int = WIDTH, rounds: int = PAIR_ROUNDS):
    """The anchor of each window: its name and its first word. ``start`` is the first word of each window."""
    key = np.zeros(len(start), dtype=np.uint64)
    first = np.zeros(len(start), dtype=np.int64)
    alive = np.arange(len(start))
    low, high = start, start + width
    begins = np.arange(len(names))
    total = len(names)

    def settle(chosen: np.ndarray, level: int) -> None:
        if len(chosen):
            sizes = np.diff(np.append(begins, total))
            best = best_symbols(low[chosen], high[chosen], names, sizes)
            key[alive[chosen]] = mix(names[best] + np.uint64(level))
            first[alive[chosen]] = begins[best]

    for level in range(rounds + 1):
        if level == 0:
            merged, place = named_runs(names)
            low_next, high_next = place[low] + 1, place[high - 1]
        else:
            right = is_right(names, level)
            merged, place = named_pairs(names, right)
            cut_low, cut_high = low + right[low], high - ~right[high - 1]
            good = cut_low < cut_high
            low_next = np.where(good, place[np.minimum(cut_low, len(place) - 1)], 1)
            high_next = np.where(good, place[np.maximum(cut_high - 1, 0)] + 1, 0)
        gone = low_next >= high_next
        settle(np.flatnonzero(gone), level)
        keep = ~gone
        alive, low, high = alive[keep], low_next[keep], high_next[keep]
        begins = begins[np.append(True, place[1:] != place[:-1])] if len(place) else begins
        names = merged
        if not len(alive):
            return key, first
    settle(np.arange(len(alive)), rounds + 1)
    return key, first


def window_hashes(names: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` words from each place, of halves that may overlap."""
    have = 1
    while have < width and len(names):
        step = min(have, width - have)
        names = pair_hash(names[:-step], names[step:])
        have += step
    return names


def _parsed(part):
    """Hash and document of each word of a slice, and where the words of each document begin."""
    begin, end, doc = words(part.data, part.starts, part.ends, ~_BLANK)
    size = np.bincount(doc, minlength=len(part.starts))
    return begin, end, word_hashes(part.data, begin, end), np.cumsum(size) - size, size


def _stretches(kind: pa.DataType, width: int):
    """For each document its digest, and a row for each stretch."""

    def stretches(batches):
        for part in slices(batches):
            begin, end, names, first_word, size = _parsed(part)
            keys, ids = part.column("row_key"), part.column("doc_id")
            raw, starts, ends = part.data.tobytes(), part.starts.tolist(), part.ends.tolist()
            digest = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_pydict({
                "row_key": keys, "doc_id": ids, "n_words": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.string()),
                "low": pa.nulls(len(digest), pa.int32()), "span": pa.nulls(len(digest), pa.int32()),
                "key": pa.nulls(len(digest), pa.int64()), "stretch": pa.nulls(len(digest), pa.int64()),
            })
            count = np.maximum(size - width + 1, 0)
            if not count.sum():
                continue
            start = np.repeat(first_word, count) + segments(count)
            owner = np.repeat(np.arange(len(size)), count)
            key, anchor = anchors(names, start, width)
            new = np.append(True, (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))
            low, high = start[new], start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
            whole = window_hashes(names, width)
            shape = ((anchor[new] - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64)
            content = pair_hash(pair_hash(whole[low], whole[high]), shape)
            doc, n = owner[new], int(new.sum())
            yield pa.RecordBatch.from_pydict({
                "row_key": keys.take(pa.array(doc)), "doc_id": ids.take(pa.array(doc)), "n_words": pa.nulls(n, pa.int64()),
                "digest": pa.nulls(n, pa.string()), "low": pa.array(low - first_word[doc], pa.int32()),
                "span": pa.array(high - low, pa.int32()), "key": pa.array(key[new].view(np.int64)),
                "stretch": pa.array(content.view(np.int64)),
            })

    return stretches


def _windows(width: int):
    """Every window of chosen stretches of each text, by two hashes."""

    def windows(batches):
        for part in slices(batches):
            _, _, names, first_word, _ = _parsed(part)
            one, two = window_hashes(names, width), window_hashes(mix(names ^ np.uint64(0x9E3779B97F4A7C15)), width)
            chosen = part.column("chosen").to_pylist()
            doc = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            low = np.array([s["low"] for c in chosen for s in c], dtype=np.int64)
            count = np.array([s["span"] + 1 for c in chosen for s in c], dtype=np.int64)
            place = np.repeat(low, count) + segments(count)
            doc = np.repeat(doc, count)
            at = place + first_word[doc]
            yield pa.RecordBatch.from_pydict({
                "one": pa.array(one[at].view(np.int64)), "two": pa.array(two[at].view(np.int64)),
                "doc_id": part.column("doc_id").take(pa.array(doc)), "row_key": part.column("row_key").take(pa.array(doc)),
                "low": pa.array(place, pa.int32()),
            })

    return windows


def _remove(width: int):
    def remove(batches):
        for part in slices(batches):
            raw, spans = part.data.tobytes(), part.column("spans").to_pylist()
            n_words, n_removed, texts = [], [], []
            for a, b, own in zip(part.starts.tolist(), part.ends.tolist(), spans):
                found = raw[a:b].split()
                cover = np.zeros(len(found) + 1, dtype=np.int64)
                np.add.at(cover, [s["low"] for s in own], 1)
                np.add.at(cover, [s["low"] + s["span"] + width for s in own], -1)
                stay = np.cumsum(cover)[:-1] == 0
                n_words.append(len(found))
                n_removed.append(len(found) - int(stay.sum()))
                texts.append(b" ".join([w for w, s in zip(found, stay.tolist()) if s]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "kept": pa.array(texts, pa.binary()),
            })

    return remove


def remove_passages(docs: DataFrame, *, width: int = WIDTH, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (UTF-8 words joined by a space; null where nothing goes).

    Every word is removed that lies in a passage of ``width`` words which also begins earlier: in a document that
    comes before, or before in its own. Documents are in order of doc_id, null first; those that share a doc_id are in order of
    the hash of their text. Rows that repeat count as one document and get the same result. Passages are judged on the texts as
    given. A null text has no words; texts of fewer words than ``width`` stay. Other columns are dropped.
    """
    rows = documents(docs, doc_id=doc_id, text=text).select("*", row_key("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType
    name = kind.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    parsed = kept(
        rows.mapInArrow(
            _stretches(to_arrow_type(kind), width),
            f"row_key long, doc_id {name}, n_words long, digest string, low int, span int, key long, stretch long",
        ),
        "parsed",
    )
    heads = parsed.where("key IS NULL").select("row_key", "doc_id", "n_words", "digest")
    found = parsed.where("key IS NOT NULL").select("row_key", "doc_id", "low", "span", "key", "stretch")
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
    again = kept(counted.where("n > 1").select("key", (F.col("a") == F.col("b")).alias("alike")), "again")
    shared = kept(found.join(again, "key"), "shared")
    heads = kept(heads, "heads")
    forget(parsed, again)

    place = F.struct("doc_id", "row_key", "low")
    firsts = kept(
        shared.groupBy("key", "stretch").agg(F.min(place).alias("at"), F.first("span").alias("span"), F.first("alike").alias("alike")),
        "firsts",
    )
    later = shared.join(firsts.select("key", "stretch", "at"), ["key", "stretch"]).where(~place.eqNullSafe(F.col("at")))
    later = kept(later.select("row_key", "low", "span"), "later")
    chosen = firsts.where("NOT alike").select("at.row_key", "at.low", "span")
    forget(shared)
    chosen = chosen.groupBy("row_key").agg(F.collect_list(F.struct("low", "span")).alias("chosen"))
    seen = later.groupBy("row_key").agg(F.collect_list(F.struct("low", "span")).alias("spans"))
    touched = chosen.join(seen, "row_key", "full")
    # The one shuffle of the texts; repeated rows are kept once.
    texts = kept(rows.dropDuplicates(["row_key"]).join(touched, "row_key"), "texts")
    forget(firsts, later)

    # Windows are made twice, which is cheaper than to write them: first to see which can occur again.
    every = texts.where("chosen IS NOT NULL").select("row_key", "doc_id", "text", "chosen").mapInArrow(
        _windows(width), f"one long, two long, doc_id {name}, row_key long, low int"
    )
    often = kept(every.groupBy("one").agg(F.count("*").alias("n")).where("n > 1").select("one"), "often")
    windows = kept(every.join(often, "one"), "windows")
    forget(often)
    earliest = windows.groupBy("one", "two").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(earliest, ["one", "two"]).where(~place.eqNullSafe(F.col("at")))
    single = kept(single.select("row_key", "low"), "single")
    forget(windows)
    more = single.groupBy("row_key").agg(F.collect_list(F.struct("low", F.lit(0).alias("span"))).alias("more"))
    none = F.expr("CAST(array() AS array<struct<low:int,span:int>>)")
    covered = texts.select("row_key", "doc_id", "text", "spans").join(more, "row_key", "left").select(
        "row_key", "doc_id", "text", F.concat(F.coalesce("spans", none), F.coalesce("more", none)).alias("spans")
    ).where(F.size("spans") > 0)
    removed = covered.select("row_key", "text", "spans", F.col("row_key").alias("doc_id")).mapInArrow(
        _remove(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    )
    removed = removed.select(F.col("doc_id").alias("row_key"), "n_removed", "kept_sha256", "kept")
    return heads.join(removed, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"), "kept",
    )
