"""Documents linked by the Jaccard similarity of their word n-grams, and their components.

Documents of the same n-gram set are one class. Two sets of similarity t share one of the first
(1 - t) n + 1 n-grams of each in any common order; the order puts n-grams first that are not frequent,
so buckets of classes that share such an n-gram are small unless the classes are near copies.

1. In each bucket the classes are compared with its first one; the links found already join most near copies.
   A bucket of two is a single pair: where it is the first n-gram the two share, their places in the order bound
   the overlap, and a pair that passes is bounded by its counts. Buckets of the same classes are searched once.
2. In larger buckets that still hold several components, an R-tree over count vectors finds the pairs of different
   components that can be similar: n-grams are hashed into groups, a set is the point of its counts, and the
   coordinate-wise minima of two points, or of a point and a box, bound the overlap from above. Large sets have
   finer groups, by which the pairs that the tree finds are bounded once more. Counts cannot refute near copies that are
   a little less similar than asked for, which come in squares; parities can. Of many more groups than n-grams each set
   has whether its count is odd: groups in which two sets differ hold at least as many n-grams that only one has.
3. The pairs that are left are verified on whole sets.

Pairs within a component found before need no test, as only components are asked for. Buckets of
many classes are cut into blocks, and pairs of blocks are separate pieces of work. A piece with many more pairs than
classes first puts out a few for each class, by a hash of the pair; when those are verified and their components joined,
it is searched again for pairs of components that are still apart, until no piece has any left.

Points go with every class of a bucket, so the larger buckets are many times the documents. A class gets its point only where
sizes and places leave it another one in its piece, and pieces are searched in passes of bounded bytes, one after the other.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graphs import components, joined_components
from tidemark.llm.texts import Slice, documents, forget, kept, lower_ascii, packed, pair_hash, row_key, segments, slices, unpacked, word_hashes, words

SHINGLE = 5
SIMILARITY = 80  # percent
GROUPS = 128
#: N-grams in a group on the average, at most; a larger set has finer groups.
PER_GROUP = 4
#: Groups of parities for each n-gram of a set, at least.
PARITIES = 4
LEAF = 16
#: Classes of a bucket that are searched together.
BLOCK_ROWS = 1024
#: Pairs that a piece of work puts out for each of its classes in the first round, and how many times more in each further one.
PAIRS_PER_CLASS = 2
MORE_PAIRS = 8
#: Bytes that a pass may shuffle, in bytes of all points; and what a row without its point takes.
PASS_POINTS = 3
ROW_BYTES = 100
#: Classes of a piece of work at most for which it is told before whether they have a pair, and pairs looked at together.
PAIRED_ROWS = 256
PAIRED_AT_ONCE = 1 << 19
#: Classes of a block whose sets are verified together.
VERIFY_ROWS = 1024
#: Counters of the sketch that tells frequent n-grams, and how far above the mean they are.
SKETCH_BITS = 18
FREQUENT = 4.0

WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False


def shingles(part: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each document has, and their hashes by document and place.

    A document of fewer words has all of them as its only shingle; one without words has none.
    """
    data = lower_ascii(part.data)
    begin, end, doc = words(data, part.starts, part.ends, WORD_BYTES)
    hashed = word_hashes(data, begin, end)
    n = np.bincount(doc, minlength=len(part.starts))
    first = np.cumsum(n) - n
    joined = hashed
    if len(hashed) >= size:
        joined = hashed[: len(hashed) - size + 1]
        for k in range(1, size):
            joined = pair_hash(joined, hashed[k : k + len(joined)])
    many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    value = joined[np.minimum(np.repeat(first, many) + segments(many), max(0, len(joined) - 1))]
    place = np.cumsum(many) - many
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():
        h = np.array([n[d]], dtype=np.uint64)
        for w in hashed[first[d] : first[d] + n[d]]:
            h = pair_hash(h, np.array([w]))
        value[place[d]] = h[0]
    return many, value


def shingle_sets(part: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct shingles of each document, by document and hash."""
    many, value = shingles(part, size)
    end = np.cumsum(many)
    for b, e in zip((end - many).tolist(), end.tolist()):
        value[b:e].sort()
    owner = np.repeat(np.arange(len(many)), many)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _counters(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(size: int):
    """Counters of a task that are well above its mean, and the sum of all of them as counter -1."""

    def sketch(batches):
        seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for part in slices(batches):
            seen += np.bincount(_counters(shingles(part, size)[1]), minlength=len(seen))
        high = np.flatnonzero(seen > 2 * seen.mean() + 2)
        counter, n = np.append(high, -1), np.append(seen[high], seen.sum())
        yield pa.RecordBatch.from_pydict({"counter": pa.array(counter, pa.int32()), "n": pa.array(n, pa.int64())})

    return sketch


def frequent_levels(texts: DataFrame, size: int) -> np.ndarray:
    """For each counter how frequent its n-grams are, 0 for most; a table of fixed size."""
    found = texts.select("text").mapInArrow(_sketch(size), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    rows = found.collect()  # a row for each counter at most
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.int8)
    if rows:
        counter, n = np.array([r["counter"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
        usual = max(1.0, n[counter < 0].sum() / len(levels))
        counter, n = counter[counter >= 0], n[counter >= 0]
        levels[counter] = np.maximum(0, np.log2(n / (FREQUENT * usual)) + 1).astype(np.int8)
    return levels


def _documents(size: int, percent: int, levels: np.ndarray):
    """Size and hash of each set, and its first n-grams in the common order."""

    def sets(batches):
        for part in slices(batches):
            owner, value = shingle_sets(part, size)
            count = len(part.starts)
            n = np.bincount(owner, minlength=count)
            end = np.cumsum(n)
            known = np.zeros(count, dtype=np.uint64)
            if len(value):
                some = np.flatnonzero(n)
                begin, mixed = (end - n)[some], pair_hash(value, n.astype(np.uint64)[owner])
                known[some] = pair_hash(np.bitwise_xor.reduceat(mixed, begin), np.add.reduceat(mixed, begin))
            # By document, level and hash: only documents with frequent n-grams are not in that order yet.
            order, level = np.arange(len(value)), levels[_counters(value)]
            frequent = np.zeros(count, dtype=bool)
            frequent[owner[level > 0]] = True
            moved = np.flatnonzero(frequent[owner])
            order[moved] = moved[np.argsort(owner[moved] << 8 | level[moved], kind="stable")]
            # A set of n shares at least ceil(t n) n-grams with one that is similar.
            prefix = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            at = np.repeat(end - n, prefix) + segments(prefix)
            first = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(first), pa.array(value[order][at].view(np.int64)))
            columns = {name: part.column(name) for name in part.rows.schema.names if name != "text"}
            columns |= {"n": pa.array(n, pa.int64()), "h": pa.array(known.view(np.int64)), "tokens": tokens}
            yield pa.RecordBatch.from_pydict(columns)

    return sets


def fine_groups(n: np.ndarray, groups: int) -> np.ndarray:
    """Groups of a set: ``groups`` times a power of two, so that few n-grams fall into one on the average.

    With many in one, sets that share nothing have like counts.
    """
    doublings = np.ceil(np.log2(np.maximum(n, 1) / (PER_GROUP * groups)))
    return groups << np.maximum(doublings, 0).astype(np.int64)


def packed_point(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs, that number first."""
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked_point(point: bytes) -> np.ndarray:
    return np.frombuffer(point, dtype=f"<u{point[0]}", offset=1).astype(np.uint32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """Counts by fewer groups; both numbers are powers of two apart."""
    return point if len(point) == groups else point.reshape(-1, groups).sum(axis=0, dtype=point.dtype)


def overlap_bounds(points: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Bounds of the overlap of pairs of sets, by the groups that the coarser one has."""
    own = np.array([len(p) for p in points])
    shared = np.minimum(own[one], own[two])
    bound = np.zeros(len(one), dtype=np.int64)
    for g in np.unique(shared).tolist():
        some = np.flatnonzero(shared == g)
        used, place = np.unique(np.concatenate([one[some], two[some]]), return_inverse=True)
        table = np.stack([folded(points[i], g) for i in used.tolist()])
        left, right = place[: len(some)], place[len(some) :]
        step = max(1, (1 << 21) // g)
        for at in range(0, len(some), step):
            low = np.minimum(table[left[at : at + step]], table[right[at : at + step]])
            bound[some[at : at + step]] = low.sum(axis=1, dtype=np.int64)
    return bound


def parity_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the parities of a set; a power of two."""
    doublings = np.ceil(np.log2(np.maximum(PARITIES * n, 64) / 64))
    return 1 << doublings.astype(np.int64)


def set_parities(owner: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set which groups have an odd number of its n-grams."""
    own = 64 * parity_words(n)
    end = np.cumsum(own)
    group = ((value >> np.uint64(24)) % own[owner].astype(np.uint64)).astype(np.int64)
    odd = np.bincount(end[owner] - own[owner] + group, minlength=int(own.sum())) & 1
    raw = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return [raw[(e - g) // 8 : e // 8] for e, g in zip(end.tolist(), own.tolist())]


def least_differences(parities: list[bytes], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many n-grams at least are in one set of a pair only, by the groups that the smaller of the two has."""
    own = np.array([len(p) // 8 for p in parities])
    shared = np.minimum(own[one], own[two])
    least = np.zeros(len(one), dtype=np.int64)
    for g in np.unique(shared).tolist():
        some = np.flatnonzero(shared == g)
        used, place = np.unique(np.concatenate([one[some], two[some]]), return_inverse=True)
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(parities[i], "<u8").reshape(-1, g), axis=0) for i in used.tolist()])
        left, right = place[: len(some)], place[len(some) :]
        step = max(1, (1 << 18) // g)
        for at in range(0, len(some), step):
            differ = np.bitwise_count(table[left[at : at + step]] ^ table[right[at : at + step]])
            least[some[at : at + step]] = differ.sum(axis=1, dtype=np.int64)
    return least


def may_be_similar(points: list[np.ndarray], parities: list[bytes], sizes: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether counts and parities leave room for the overlap that the sizes of a pair need."""
    needed = needed_overlap(sizes[one], sizes[two], percent)
    good = overlap_bounds(points, one, two) >= needed
    left = np.flatnonzero(good)
    differ = least_differences(parities, one[left], two[left])
    good[left] = sizes[one[left]] + sizes[two[left]] - differ >= 2 * needed[left]
    return good


def _points(size: int, groups: int):
    """Size of the set of each document, and the counts and parities of its n-grams by group."""

    def points(batches):
        for part in slices(batches):
            owner, value = shingle_sets(part, size)
            n = np.bincount(owner, minlength=len(part.starts))
            own = fine_groups(n, groups)
            end = np.cumsum(own)
            group = (value % own[owner].astype(np.uint64)).astype(np.int64)
            counts = np.bincount(end[owner] - own[owner] + group, minlength=int(own.sum()))
            yield pa.RecordBatch.from_pydict({
                "h": part.column("h"), "n": pa.array(n, pa.int64()),
                "point": pa.array([packed_point(counts[e - g : e]) for e, g in zip(end.tolist(), own.tolist())], pa.binary()),
                "parity": pa.array(set_parities(owner, value, n), pa.binary()),
            })

    return points


def _members(size: int):
    """The whole set of each document."""

    def members(batches):
        for part in slices(batches):
            owner, value = shingle_sets(part, size)
            n = np.bincount(owner, minlength=len(part.starts))
            end = np.cumsum(n)
            raw = value.tobytes()
            yield pa.RecordBatch.from_pydict({
                "h": part.column("h"),
                "members": pa.array([raw[8 * (e - k) : 8 * e] for e, k in zip(end.tolist(), n.tolist())], pa.binary()),
            })

    return members


def _possible(percent: int):
    """Pairs whose counts and parities by group leave room for the overlap their sizes need."""

    def possible(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                points, parities = ([p for x in "ab" for p in rows.column(f"{c}_{x}").to_pylist()] for c in ("point", "parity"))
                sizes = np.concatenate([rows.column(f"n_{x}").to_numpy() for x in "ab"])
                at_one = np.arange(rows.num_rows)
                good = may_be_similar([unpacked_point(p) for p in points], parities, sizes, at_one, at_one + rows.num_rows, percent)
                yield rows.select(["a", "b"]).filter(pa.array(good))

    return possible


def needed_overlap(one, two, percent: int = SIMILARITY):
    """Least intersection of sets of these sizes that are similar: 100 i >= t (one + two - i)."""
    return (percent * (one + two) + 99 + percent) // (100 + percent)


def _verify(percent: int):
    """Rows come sorted by piece of work, in each the sets before the pairs."""

    def verify(batches):
        key, known = None, {}
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                own = (row["family"], row["low"], row["high"])
                if own != key:
                    key, known = own, {}
                if row["members"] is not None:
                    known[row["a"]] = np.frombuffer(row["members"], np.uint64)
                    continue
                one, two = known[row["a"]], known[row["b"]]
                if len(one) > len(two):
                    one, two = two, one
                place = np.minimum(np.searchsorted(two, one), len(two) - 1)
                both = int((two[place] == one).sum())
                if 100 * both >= percent * (len(one) + len(two) - both):
                    a.append(row["a"])
                    b.append(row["b"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def verified_links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets are similar; ``texts`` has a text of each class (h, text).

    Pairs that hang together are a family, whose classes are cut into blocks of bounded size. A piece of work
    is two blocks with a pair between them; it gets each set of the two once, however many pairs there are.
    """
    family = components(pairs).select(F.col("id").alias("h"), F.col("label").alias("family"))
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("blocks"))
    placed = kept(
        family.join(blocks, "family").select("h", "family", F.pmod(F.hash("h"), F.col("blocks")).alias("block")), "placed"
    )
    one = placed.select(F.col("h").alias("a"), "family", F.col("block").alias("x"))
    two = placed.select(F.col("h").alias("b"), F.col("block").alias("y"))
    asked = kept(
        pairs.join(one, "a").join(two, "b").select("a", "b", "family", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")),
        "asked",
    )
    work = asked.select("family", "low", "high").distinct()
    sides = work.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    whole = texts.join(placed.select("h"), "h").select("text", "h").mapInArrow(_members(size), "h long, members binary")
    sets = sides.join(placed, ["family", "block"]).join(whole, "h")
    none = F.lit(None)
    rows = sets.select("family", "low", "high", F.col("h").alias("a"), none.cast("long").alias("b"), "members").unionByName(
        asked.withColumn("members", none.cast("binary"))
    )
    rows = rows.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", F.col("b").isNotNull())
    found = kept(rows.mapInArrow(_verify(percent), "a long, b long"), "verified")
    forget(placed, asked)
    return found


class CountTree:
    """R-tree over points: boxes of ``LEAF`` points, of so many boxes, and so on."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        half = points.shape[1] // 2
        self.order = np.lexsort((points[:, :half].sum(axis=1, dtype=np.int64), sizes // max(1, LEAF)))
        high, low = points[self.order], sizes[self.order]
        self.levels = [(high, low)]
        while len(low) > LEAF:
            cut = np.arange(0, len(low), LEAF)
            high, low = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low, cut)
            self.levels.append((high, low))

    def pairs(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) whose overlap may reach what their sizes need."""
        high, _ = self.levels[-1]
        query = np.repeat(np.arange(len(points)), len(high))
        node = np.tile(np.arange(len(high)), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            good = np.zeros(len(query), dtype=bool)
            for at in range(0, len(query), 1 << 15):
                q, v = query[at : at + (1 << 15)], node[at : at + (1 << 15)]
                bound = np.minimum(points[q], high[v]).sum(axis=1, dtype=np.int64)
                least = np.maximum(low[v], -(-percent * sizes[q] // 100))
                good[at : at + (1 << 15)] = bound >= needed_overlap(sizes[q], least, percent)
            query, node = query[good], node[good]
            if depth:
                below = np.minimum((node + 1) * LEAF, len(self.levels[depth - 1][1])) - node * LEAF
                query, node = np.repeat(query, below), np.repeat(node * LEAF, below) + segments(below)
        return query, self.order[node]


WORK_SCHEMA = "token long, h long, n long, label long, at int, block int, pieces int, low int, high int, upto long"
FOUND_SCHEMA = "a long, b long, token long, low int, high int, upto long"


def whole_pieces(batches):
    """Batches cut where a bucket and pair of blocks ends; rows come sorted by these."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "low", "high")], 1)
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        new[0] = last is not None and bool((key[0] != last).any())
        last, cuts = key[-1], np.flatnonzero(new)
        if len(cuts):
            held.append(batch.slice(0, cuts[-1]))
            if any(b.num_rows for b in held):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cuts[-1] if len(cuts) else 0))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def piece_lengths(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each piece of work."""
    key = np.stack([rows[c] for c in ("token", "low", "high")], 1)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    return first, np.diff(np.append(first, len(key)))


def early(rows: dict, q: np.ndarray, p: np.ndarray, percent: int) -> np.ndarray:
    """Whether what is left of both sets from here on is enough."""
    rest = np.minimum(rows["n"][q] - rows["at"][q], rows["n"][p] - rows["at"][p])
    return rest >= needed_overlap(rows["n"][q], rows["n"][p], percent)


def _paired(percent: int):
    """Rows with another one in their piece of work that they may be similar to, as far as sizes and places tell.

    Rows come sorted by piece; those of a large piece stay.
    """

    def paired(batches):
        for batch in whole_pieces(batches):
            rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            first, length = piece_lengths(rows)
            good = np.repeat(length > PAIRED_ROWS, length)
            first, length = first[length <= PAIRED_ROWS], length[length <= PAIRED_ROWS]
            part = np.cumsum(length**2) // PAIRED_AT_ONCE
            for k in np.unique(part).tolist():
                own = length[part == k]
                begin, width = np.repeat(first[part == k], own), np.repeat(own, own)
                q = np.repeat(begin + segments(own), width)
                p = np.repeat(begin, width) + segments(width)
                asked = (rows["label"][q] != rows["label"][p]) & ((rows["low"][q] == rows["high"][q]) | (rows["block"][q] != rows["block"][p]))
                q, p = q[asked], p[asked]
                good[q[early(rows, q, p, percent)]] = True
            yield batch.filter(pa.array(good))

    return paired


def point_bytes(n: str) -> Column:
    """About what the counts and parities of a set of this size take."""
    return F.lit(GROUPS + 2 * ROW_BYTES) + F.col(n) * 1.25


def in_passes(rows: DataFrame, key: list[str], weight: Column, most: float) -> list[DataFrame]:
    """All of ``rows`` in parts by a hash of ``key``, of about ``most`` bytes each by ``weight``."""
    count = max(1, math.ceil((rows.agg(F.sum(weight)).first()[0] or 0) / most))
    place = F.pmod(F.xxhash64(F.lit(count), *key), F.lit(count))
    return [rows] if count == 1 else [rows.where(place == i) for i in range(count)]


def _search(percent: int, groups: int, most: int):
    """Rows come sorted by bucket and pair of blocks; emits pairs of different components that may be similar.

    Of two blocks the pairs between them are searched. A pair that is similar shares its first common n-gram early enough
    in the order (``at``, the place of the bucket's n-gram in the set); it comes from that bucket.
    Of a piece of work with more than ``most`` pairs for each class, which all ``pieces`` of the class share, and more
    than a few, the first ones by a hash, and a row that names the piece and the last hash: a later round goes on behind it.
    """
    cuts = []

    def found(rows: dict, points, parities):
        label, h, sizes, block = rows["label"], rows["h"], rows["n"], rows["block"]
        names, own = np.unique(label, return_inverse=True)
        if len(names) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fine = [unpacked_point(p) for p in points.to_pylist()]
        table = np.stack([folded(p, groups) for p in fine])
        if table.max() < 1 << 16:
            table = table.astype(np.uint16)
        # No pair lies within the largest component, so its classes ask for none.
        usual = own == np.bincount(own).argmax()
        asks = np.flatnonzero(~usual)
        q, p = CountTree(table, sizes).pairs(table[asks], sizes[asks], percent)
        q = asks[q]
        good = (label[q] != label[p]) & (usual[p] | (h[q] < h[p])) & early(rows, q, p, percent)
        if rows["low"][0] != rows["high"][0]:
            good &= block[q] != block[p]
        q, p = q[good], p[good]
        q, p = np.where(h[q] < h[p], q, p), np.where(h[q] < h[p], p, q)
        token = np.uint64(int(rows["token"][0]) & (1 << 64) - 1)
        spread = (pair_hash(pair_hash(h[q].view(np.uint64), h[p].view(np.uint64)), token) >> np.uint64(1)).astype(np.int64)
        rest = spread > rows["upto"][0]
        q, p, spread = q[rest], p[rest], spread[rest]
        similar = may_be_similar(fine, parities.to_pylist(), sizes, q, p, percent)
        q, p, spread = q[similar], p[similar], spread[similar]
        limit = int(most * min(len(h), max((1 / rows["pieces"]).sum(), 8 * LEAF)))
        if len(q) > limit:
            upto = np.partition(spread, limit - 1)[limit - 1]
            q, p = q[spread <= upto], p[spread <= upto]
            cuts.append((rows["token"][0], rows["low"][0], rows["high"][0], int(upto)))
        return h[q], h[p]

    def single_leaves(rows: dict, length: np.ndarray, points, parities):
        """Many buckets that are a single leaf each, at once."""
        first = np.repeat(np.cumsum(length) - length, length)
        width = np.repeat(length, length)
        q = np.repeat(np.arange(len(first)), width)
        p = np.repeat(first, width) + segments(width)
        sizes, label, h = rows["n"], rows["label"], rows["h"]
        good = (label[q] != label[p]) & (h[q] < h[p])
        q, p = q[good], p[good]
        low, high = np.minimum(sizes[q], sizes[p]), np.maximum(sizes[q], sizes[p])
        good = (100 * low >= percent * high) & early(rows, q, p, percent)
        q, p = q[good], p[good]
        known, code = np.unique(h, return_inverse=True)
        _, once = np.unique(code[q] * len(known) + code[p], return_index=True)
        q, p = q[once], p[once]
        used, place = np.unique(np.concatenate([q, p]), return_inverse=True)
        fine, used_parities = [unpacked_point(x) for x in points.take(pa.array(used)).to_pylist()], parities.take(pa.array(used)).to_pylist()
        similar = may_be_similar(fine, used_parities, sizes[used], place[: len(q)], place[len(q) :], percent)
        return h[q[similar]], h[p[similar]]

    def search(batches):
        out, size = [], 0
        for batch in whole_pieces(batches):
            rows = {c: batch.column(c).to_numpy() for c in batch.schema.names if c not in ("point", "parity")}
            rows = {"at": np.zeros(batch.num_rows, np.int64), "block": rows["low"], "pieces": np.ones(batch.num_rows)} | rows
            points, parities = batch.column("point"), batch.column("parity")
            first, length = piece_lengths(rows)
            for f, n in zip(first[length > LEAF].tolist(), length[length > LEAF].tolist()):
                out.append(found({c: x[f : f + n] for c, x in rows.items()}, points.slice(f, n), parities.slice(f, n)))
                size += len(out[-1][0])
            small = np.flatnonzero(np.repeat(length <= LEAF, length))
            if len(small):
                at = pa.array(small)
                out.append(single_leaves({c: x[small] for c, x in rows.items()}, length[length <= LEAF], points.take(at), parities.take(at)))
                size += len(out[-1][0])
            if size > 50_000:
                yield _found(out, cuts)
                out, size = [], 0
                cuts.clear()
        if out:
            yield _found(out, cuts)

    return search


def _found(found, cuts: list[tuple]) -> pa.RecordBatch:
    """Distinct pairs, and the pieces of work that have more of them."""
    both = np.unique(np.stack([np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])], 1), axis=0)
    pairs = {"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())}
    left = {c: pa.array([x[i] for x in cuts], t) for i, (c, t) in enumerate((("token", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("upto", pa.int64())))}
    columns = {c: pa.concat_arrays([x, pa.nulls(len(cuts), x.type)]) for c, x in pairs.items()}
    columns |= {c: pa.concat_arrays([pa.nulls(len(both), x.type), x]) for c, x in left.items()}
    return pa.RecordBatch.from_pydict(columns)


def similar_documents(
    docs: DataFrame, *, size: int = SHINGLE, percent: int = SIMILARITY, doc_id="doc_id", text="text", groups: int = GROUPS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    component_id is the smallest doc_id that links lead to, itself included. Documents without words
    (null and empty texts too) have no shingle and are linked with nothing. Rows that repeat are documents
    with the same set. A null doc_id is never the smallest; where a component has no other, component_id is
    null. Other columns are dropped.
    """
    rows = documents(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    levels = frequent_levels(rows, size)
    keyed = rows.select("*", row_key("doc_id", "text"))
    found = kept(
        keyed.mapInArrow(_documents(size, percent, levels), f"doc_id {kind}, row_key long, n long, h long, tokens array<long>"), "sets"
    )
    classes = kept(
        found.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key")), "classes"
    )
    entries = found.where("n > 0").select("h", "n", F.posexplode("tokens").alias("at", "token"))
    buckets = kept(
        entries.groupBy("token").agg(F.min("h").alias("first"), F.max("h").alias("b")).where("first <> b").select("token", "first"), "buckets"
    )
    one_each = [F.min(c).alias(c) for c in ("first", "n", "at")]  # a set has one size, and an n-gram one place in it
    shared = kept(entries.join(buckets, "token").groupBy("token", "h").agg(*one_each), "shared")
    sizes = kept(found.select("doc_id", "n", "h"), "sizes")
    forget(found, buckets)
    involved = classes.join(shared.select("h").distinct(), "h").select("row_key", "h")
    # The one shuffle of all texts; rows that repeat are side by side then.
    texts = kept(keyed.select("row_key", "text").join(involved, "row_key").dropDuplicates(["row_key"]).select("text", "h"), "texts")
    points = kept(texts.mapInArrow(_points(size, groups), "h long, n long, point binary, parity binary"), "points")
    in_pass = PASS_POINTS * (points.agg(F.sum(point_bytes("n"))).first()[0] or 1)

    def together(tables: list[DataFrame], name: str) -> DataFrame:
        if len(tables) == 1:
            return tables[0]
        joined = kept(reduce(DataFrame.unionByName, tables), name)
        forget(*tables)
        return joined

    close = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)

    def possible(pairs: DataFrame) -> DataFrame:
        one, two = (points.select(F.col("h").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
        return bounded(pairs.join(one, "a").join(two, "b").where(close))

    def bounded(pairs: DataFrame) -> DataFrame:
        pairs, found = kept(pairs.select("a", "b", "n_a", "n_b"), "sized"), []
        for sized in in_passes(pairs, ["a", "b"], point_bytes("n_a") + point_bytes("n_b"), in_pass):
            for x in "ab":
                sized = sized.join(points.select(F.col("h").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("point", "parity")]), x)
            found.append(kept(sized.mapInArrow(_possible(percent), "a long, b long"), "close"))
        forget(pairs)
        return together(found, "close")

    # The firsts with which a class shares most n-grams: enough to join most near copies.
    firsts = shared.where("first <> h").groupBy(F.col("first").alias("a"), F.col("h").alias("b")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    tried = kept(firsts.withColumn("place", place).where("place <= 3").select("a", "b"), "tried")
    links = verified_links(possible(tried), texts, size, percent)
    labels = components(links)

    labelled = shared.select("token", "h", "n", "at").join(labels.withColumnRenamed("id", "h"), "h", "left")
    labelled = kept(labelled.select("token", "h", "n", "at", F.coalesce("label", "h").alias("label")), "labelled")
    forget(shared)
    entry, mixed = F.struct("h", "n", "at"), F.xxhash64("h")
    parts = in_passes(labelled, ["token"], F.lit(ROW_BYTES), in_pass)
    open_ = together([
        kept(
            some.groupBy("token").agg(
                F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows"), F.min(entry).alias("one"), F.max(entry).alias("two"),
                F.bit_xor(mixed).alias("mixed"), F.sum(F.shiftright(mixed, 24)).alias("summed"),
            ).where("x <> y").drop("x", "y"),
            "open",
        )
        for some in parts
    ], "open")
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # If a pair shares no n-gram before this one, it shares no more than the shorter rest of the two.
    rest = F.least(F.col("n_a") - F.col("one.at"), F.col("n_b") - F.col("two.at"))
    enough = rest * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    twos = open_.where("rows = 2").select("*", *[F.col(f"{s}.{c}").alias(n) for s, c, n in (("one", "h", "a"), ("two", "h", "b"), ("one", "n", "n_a"), ("two", "n", "n_b"))])
    single = bounded(twos.where(close & enough).select("a", "b", "n_a", "n_b").distinct().join(done, ["a", "b"], "left_anti"))
    # Buckets of the same classes give the same pairs: one of them is searched.
    blocks = F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")
    first_token = F.min_by("token", "one.at").alias("token")  # the first of them in the order of its classes
    several = kept(open_.where("rows > 2").groupBy("rows", "mixed", "summed").agg(first_token).select("token", blocks), "several")
    forget(open_)
    # A class is in about as many buckets as n-grams of it come first.
    pieces = (F.col("blocks") * (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).cast("int").alias("pieces")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data may be much work
    piece, superseded = ["token", "low", "high"], []
    for some in parts:
        left = some.join(several, "token").withColumn("block", F.pmod(F.hash("h"), F.col("blocks")))
        dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "token", "h", "n", "label", "at", "block", pieces, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            F.lit(-1).cast("long").alias("upto"),
        )
        in_order = dealt.repartition(tasks, *piece).sortWithinPartitions(*piece)
        superseded.append(kept(in_order.mapInArrow(_paired(percent), WORK_SCHEMA), "work"))
    forget(several, labelled)
    work, most, asked, cut = reduce(DataFrame.unionByName, superseded), PAIRS_PER_CLASS, [], None
    while cut is None or not cut.isEmpty():
        if cut is not None:
            again = kept(work.drop("label", "upto").join(cut, piece), "again")
            forget(*searched, *superseded)
            relabelled = again.join(labels.withColumnRenamed("id", "h"), "h", "left").withColumn("label", F.coalesce("label", "h"))
            apart = relabelled.groupBy(*piece).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(*piece)
            work, most, superseded = relabelled.join(apart, piece, "left_semi"), most * MORE_PAIRS, [again]
        searched = []
        for some in in_passes(work, piece, point_bytes("n"), in_pass):
            in_order = some.join(points.drop("n"), "h").repartition(tasks, *piece).sortWithinPartitions(*piece)
            searched.append(kept(in_order.mapInArrow(_search(percent, groups, most), FOUND_SCHEMA).distinct(), "maybe"))
        maybe = reduce(DataFrame.unionByName, searched)
        pairs = maybe.where("a IS NOT NULL").select("a", "b").join(done, ["a", "b"], "left_anti")
        asked.append(kept((pairs if asked else pairs.union(single)).distinct(), "untried"))
        done = done.union(asked[-1])
        labels = joined_components(labels, verified_links(asked[-1], texts, size, percent))
        cut = maybe.where("token IS NOT NULL").select(*piece, "upto")
    forget(*searched, *superseded, *asked, single, texts, points)

    named = classes.join(labels.withColumnRenamed("id", "h"), "h", "left").select("h", "least", F.coalesce("label", "h").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "label").select("h", "component_id")
    joined = sizes.join(by_class, "h", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without those similar to one of smaller doc_id, by links; all columns as they were.

    Rows that repeat a doc_id are one document: one of them stays. Those without a doc_id stay. Columns may have any names.
    """
    found = similar_documents(docs, doc_id=doc_id, text=text)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    rows = packed(docs, doc_id=doc_id, text=text)
    rest = rows.join(gone, "doc_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    single = rest.join(again, "doc_id", "left_anti")
    double = rest.join(again, "doc_id", "left_semi").withColumn("place", place).where("place = 1").drop("place")
    return unpacked(single.unionByName(double), docs.columns, text=text)
