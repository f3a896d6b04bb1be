"""Periodic runs of words, found in overlapping tiles of every period octave and stitched.

For the octave of periods ``S <= q < 2S`` a text has a boundary at every S-th word. A run that repeats its
period four times crosses three boundaries or more, and at the first of them the next 2S words come again q words
later (in the lowest octave, the next four). Boundaries where that is so have a tile: S words before, 5S after. Tiles
are solved one by one: the Z-function of what follows the boundary tells for all periods at once how far words keep
agreeing, that of the reversed front how far they agreed before. A tile sees at most S words back and 3S
ahead, so a run leaves fragments that touch; they are shuffled by document and period and joined. A fragment whose two
ends a tile sees is dropped there if it is too short.

A period whose root is itself a repetition is not the smallest one and leaves no fragment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import documents, kept, mix, pair_hash, slices

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def z_function(x: list[int]) -> list[int]:
    """At each place the length of the longest prefix of ``x`` that begins there; its own length at 0."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prime_factors(q: int) -> list[int]:
    found, r = [], 2
    while r * r <= q:
        if q % r == 0:
            found.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return found + [q] if q > 1 else found


def again(octave: int) -> int:
    """So many words come again at the first boundary within any run of the octave."""
    return max(2 * octave, LEAST_WORDS - 2)


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def solve_tile(words: list[int], at: int, octave: int) -> list[tuple[int, int, int]]:
    """Fragments (period, first, last) of a tile: words from first to before last come again a period later.

    ``at`` is the boundary's place in the tile. Only smallest periods are returned.
    """
    least = again(octave)
    reach = least + octave
    ahead = z_function(words[at : at + reach + 2 * octave])
    chosen = []
    for q in range(octave, min(2 * octave, len(ahead))):
        if ahead[q] >= least and all(ahead[q // r] < q - q // r for r in prime_factors(q)):
            chosen.append(q)
    if not chosen:
        return []
    front = words[max(0, at - octave) : at]
    end = min(len(words), at + 2 * octave)
    behind = z_function([*reversed(front), -1, *reversed(words[at - len(front) : end])])
    found = []
    for q in chosen:
        back = min(behind[len(front) + 1 + end - at - q], len(front)) if front else 0
        whole = back < octave and ahead[q] < reach
        if not whole or back + ahead[q] + q >= least_length(q):
            found.append((q, at - back, at + min(ahead[q], reach)))
    return found


def joined(hashes: np.ndarray, size: int, place: np.ndarray) -> np.ndarray:
    """Hashes of blocks twice as long; those that go over the end are of no use and made different."""
    longer = pair_hash(hashes[:-size], hashes[size:]) if len(hashes) > size else hashes[:0]
    return np.concatenate([longer, mix(place[len(longer) :].astype(np.uint64))])


def tiles(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """octave, document, start and boundary of each tile; places are within ``codes``.

    Documents lie one after the other, each followed by a code of its own. Hashes only choose: a block
    that does come again always has its tile.
    """
    hashes = mix(codes.astype(np.int64).view(np.uint64) + np.uint64(1))
    place = np.arange(len(codes))  # of the words still looked at, within ``codes``
    owner = np.repeat(np.arange(len(starts)), lengths + 1)
    octave = 1
    while True:
        long_enough = lengths >= least_length(octave)
        if not long_enough.any():
            return
        mask = long_enough[owner]
        if not mask.all():
            hashes, place, owner = hashes[mask], place[mask], owner[mask]
        blocks = -(-len(hashes) // octave)
        longer = joined(hashes, octave, place)
        padded = np.zeros((blocks + 2) * octave, dtype=np.uint64)
        padded[: len(hashes)] = longer if octave > 1 else joined(longer, 2, place)
        own = padded[: blocks * octave : octave]
        later = padded[octave : octave + blocks * octave].reshape(blocks, octave)
        for b in (np.flatnonzero((later == own[:, None]).any(axis=1)) * octave).tolist():
            doc, boundary = int(owner[b]), int(place[b])
            if boundary < starts[doc] + lengths[doc]:
                yield octave, doc, max(int(starts[doc]), boundary - octave), boundary
        hashes = longer
        octave *= 2


def _fragments(kind: pa.DataType, rewrite: Rewrite | None):
    """Of each document one row of its own and a row for each fragment."""
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", kind), ("n_words", pa.int64()), ("body", pa.binary()), ("digest", pa.string()),
        ("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64()),
    ])

    def table(**columns) -> pa.RecordBatch:
        count = len(columns["row"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema
        )

    def solve(batches):
        for part in slices(batches):
            raw, rows, ids = part.data.tobytes(), part.column("row").to_pylist(), part.column("doc_id").to_pylist()
            codes, lengths, bodies, seen = [], [], [], {}
            for doc, (start, end) in enumerate(zip(part.starts.tolist(), part.ends.tolist())):
                words = raw[start:end].split()  # at blanks and at bytes 9 to 13, as those of a bytes object are
                if rewrite is not None:
                    words = rewrite(ids[doc], words)
                bodies.append(b" ".join(words))
                lengths.append(len(words))
                codes += [seen.setdefault(w, len(seen)) for w in words]
                codes.append(-2 - doc)
            codes, lengths = np.array(codes, dtype=np.int64), np.array(lengths, dtype=np.int64)
            starts = np.cumsum(lengths + 1) - lengths - 1
            tiled, found = set(), []
            for octave, doc, begin, boundary in tiles(codes, starts, lengths):
                end = min(boundary + again(octave) + 3 * octave, int(starts[doc] + lengths[doc]))
                solved = solve_tile(codes[begin:end].tolist(), boundary - begin, octave)
                if solved:
                    tiled.add(doc)
                shift = begin - int(starts[doc])
                found += [(rows[doc], q, a + shift, b + shift) for q, a, b in solved]
                if len(found) >= 50_000:
                    yield table(**dict(zip(("row", "period", "first", "last"), map(list, zip(*found)))))
                    found = []
            if found:
                yield table(**dict(zip(("row", "period", "first", "last"), map(list, zip(*found)))))
            yield table(
                row=rows, doc_id=ids, n_words=lengths,
                body=[b if i in tiled else None for i, b in enumerate(bodies)],
                digest=[None if i in tiled else hashlib.sha256(b).hexdigest() for i, b in enumerate(bodies)],
            )

    return solve


_RUN = "struct<start:long,length:long,period:long>"


def _collapse(batches):
    """Digests of the runs, the run of greatest exponent, and the words that stay."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = batch.slice(at, 200).to_pylist()
            best, texts, listed = [], [], []
            for row in rows:
                runs = sorted(((r["start"], r["period"], r["length"]) for r in row["runs"] or []))
                words = row["body"].split(b" ") if row["body"] else []
                drop = np.zeros(len(words) + 1, dtype=np.int64)
                for start, period, length in runs:
                    drop[start + period] += 1
                    drop[start + length] -= 1
                stay = np.cumsum(drop)[:-1] == 0
                texts.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]))
                listed.append([{"start": s, "length": n, "period": q} for s, q, n in runs])
                best.append(min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=(None, None, None)))
            digests = [
                hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs).encode()).hexdigest()
                for runs in listed
            ]
            integers = lambda values: pa.array(values, pa.int64())
            part = batch.slice(at, 200)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(part.schema.get_field_index("doc_id")),
                "n_words": part.column(part.schema.get_field_index("n_words")),
                "n_runs": integers([len(r) for r in listed]), "start": integers([b[0] for b in best]),
                "length": integers([b[2] for b in best]), "period": integers([b[1] for b in best]),
                "exponent_milli": integers([None if b[1] is None else 1000 * b[2] // b[1] for b in best]),
                "runs_sha256": pa.array(digests), "collapsed_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                "runs": pa.array(listed, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                "collapsed": pa.array(texts, pa.binary()),
            })


def find_runs(docs: DataFrame, *, doc_id="doc_id", text="text", rewrite: Rewrite | None = None) -> DataFrame:
    """The periodic runs of words of every whole text, and the text with each run cut to its first period.

    A run is a longest stretch of words with smallest period q, of at least four periods and six words. Returns
    doc_id, n_words, n_runs, the run of greatest length / period (start, length, period, exponent_milli; of equal
    ones the first, then that of smallest period; null without a run), runs_sha256, collapsed_sha256, runs (by start,
    then period) and collapsed (UTF-8; null for texts of which no stretch came into question and nothing goes).

    ``rewrite`` gets the doc_id and the words of each text and returns those to look at. A null or empty text has no
    words. Rows that repeat are documents of their own, with the same result. Other columns are dropped.
    """
    rows = documents(docs, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    found = kept(
        rows.mapInArrow(
            _fragments(_arrow_type(kind), rewrite),
            f"row long, doc_id {kind.simpleString()}, n_words long, body binary, digest string, period long, first long, last long",
        ),
        "fragments",
    )
    pieces = found.where("period IS NOT NULL").select("row", "period", "first", "last")
    along = Window.partitionBy("row", "period").orderBy("first", "last")
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first") <= F.col("_reach"), 0).otherwise(1)
    stitched = (
        pieces.withColumn("_reach", reach).withColumn("_run", F.sum(begins).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "period", "_run").agg(F.min("first").alias("start"), F.max("last").alias("end"))
        .select("row", "period", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"))
        .where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))
    )
    by_row = stitched.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    heads = found.where("period IS NULL")
    tiled = heads.where("digest IS NULL").select("row", "doc_id", "n_words", "body").join(by_row, "row", "left")
    with_runs = tiled.select("doc_id", "n_words", "body", "runs").mapInArrow(
        _collapse,
        f"doc_id {kind.simpleString()}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
        f"runs_sha256 string, collapsed_sha256 string, runs array<{_RUN}>, collapsed binary",
    )
    none = F.lit(None).cast("long")
    without = heads.where("digest IS NOT NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        none.alias("exponent_milli"), F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"),
        F.expr(f"CAST(array() AS array<{_RUN}>)").alias("runs"), F.lit(None).cast("binary").alias("collapsed"),
    )
    return with_runs.unionByName(without)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
