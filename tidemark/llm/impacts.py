"""Exact top-k by inner product over an impact-ordered index, score at a time.

Each task cuts its vectors into shards of a bounded number of rows. A shard keeps, for every
dimension, its rows in segments of equal quantised value. A query reads the segments of all dimensions by
descending impact and adds each to the scores of its rows. It stops when no row outside a small set can
still reach the k-th best score that is certain; the rows of that set are then scored
exactly. Queries meet shards in blocks, and the best k of each shard are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import kept, ship

SHARD_ROWS = 4096
QUERY_ROWS = 512
#: Bits dropped by quantising; a segment holds values that differ below them.
SHIFT = 4
#: Share of the largest impact by which one round goes down.
ROUND = 0.2
#: Rows of a shard that may still be members when reading stops, as a multiple of k.
FEW = 8

SHARD_SCHEMA = "shard string, n int, dim int, ids binary, vectors binary, orders binary, dims binary, begins binary, levels binary"


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Rows as a matrix; shorter vectors are filled with zeros."""
    dim = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Shard:
    """Vectors of some rows and their segments: by dimension, then from high to low values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, dims: np.ndarray, begins: np.ndarray, levels: np.ndarray):
        self.ids, self.vectors, self.orders, self.begins = ids, vectors, orders, begins
        self.dims, self.levels = dims, levels << SHIFT
        self.sizes = np.diff(np.append(begins, len(orders)))
        self.slots = np.repeat(self.levels, self.sizes).astype(np.float64)
        self.firsts = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else begins

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Shard:
        level = (vectors >> SHIFT).T
        order = np.argsort(-level, axis=1, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(level, order.astype(np.int64), axis=1)
        first = np.ones(ordered.shape, dtype=bool)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        dims = np.repeat(np.arange(len(level)), first.sum(axis=1))
        begins = np.flatnonzero(first.ravel())
        return cls(ids, vectors, order.ravel(), dims, begins, ordered.ravel()[begins])

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best k rows but the query's own, and how many were scored exactly."""
        dim = min(len(query), self.vectors.shape[1])
        query = query[:dim]
        others = self.ids != own
        candidates = np.flatnonzero(others)
        n, width = len(self.ids), (1 << SHIFT) - 1
        # Impact of a segment: what its rows add at least, above the least that its dimension adds.
        weight = np.append(query, np.zeros(self.vectors.shape[1] - dim, dtype=np.int64))[self.dims]
        impact = weight * self.levels + np.minimum(weight * width, 0)
        shift = np.minimum(weight * width, 0)[self.firsts]
        if len(impact):
            least = np.minimum.reduceat(impact, self.firsts)
            impact, shift = impact - least[self.dims], shift - least
        slack = int(np.abs(query).sum()) * width  # what quantising hides, at most
        if not len(impact) or float(impact.max()) * dim + slack >= 2**52:
            return self._best(candidates, query, k)
        order = np.argsort(-impact, kind="stable")
        order = order[: np.searchsorted(-impact[order], 0)]  # segments that add nothing are never read
        impact, dims, size = impact[order], self.dims[order], self.sizes[order]
        top = impact[0] if len(impact) else 0
        rounds = np.searchsorted(-impact, -(top * np.arange(1 - ROUND, -ROUND, -ROUND)), side="right")
        low, at, read = np.zeros(n), 0, np.zeros(self.vectors.shape[1], dtype=np.int64)
        for until in np.unique(np.append(rounds, len(impact))).tolist():
            if until > at:
                # Segments of a dimension are read from its high end, or from its low end, without gaps.
                taken = np.bincount(dims[at:until], size[at:until], minlength=len(read)).astype(np.int64)
                rows, added = [], []
                for d in np.flatnonzero(taken).tolist():
                    w, done, more = int(weight[self.firsts[d]]), int(read[d]), int(taken[d])
                    first = d * n + done if w > 0 else (d + 1) * n - done - more
                    rows.append(self.orders[first : first + more])
                    added.append(self.slots[first : first + more] * float(w) + float(shift[d]))
                low += np.bincount(np.concatenate(rows), np.concatenate(added), minlength=n)
                read += taken
            at = until
            if len(candidates) <= k:
                break
            # What each dimension can still add: the impact of its next segment.
            rest = int(impact[at:][np.unique(dims[at:], return_index=True)[1]].sum())
            sure = np.partition(low[candidates], len(candidates) - k)[len(candidates) - k]
            # A row below this cannot be among the best k; ties stay.
            candidates = candidates[low[candidates] + slack + rest >= sure]
            if len(candidates) <= FEW * k:
                break
        return self._best(candidates, query, k)

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int):
        scores = self.vectors[rows, : len(query)] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order], len(rows)


def _shards(rows_of_shard: int):
    def shards(batches):
        part, number, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def row():
            matrix = _matrix(vectors)
            built = Shard.build(np.array(ids, dtype=np.int64), matrix)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([f"{part}-{number}"]), "n": pa.array([len(ids)], pa.int32()),
                "dim": pa.array([matrix.shape[1]], pa.int32()), "ids": pa.array([built.ids.tobytes()], pa.binary()),
                "vectors": pa.array([matrix.tobytes()], pa.binary()),
                "orders": pa.array([built.orders.tobytes()], pa.binary()),
                "dims": pa.array([built.dims.tobytes()], pa.binary()), "begins": pa.array([built.begins.tobytes()], pa.binary()),
                "levels": pa.array([(built.levels >> SHIFT).tobytes()], pa.binary()),
            })

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(vec_id)
                vectors.append(vector)
                if len(ids) == rows_of_shard:
                    yield row()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield row()

    return shards


def _read(row: dict) -> Shard:
    n, dim = row["n"], row["dim"]
    wide = (np.frombuffer(row[name], np.int64) for name in ("dims", "begins", "levels"))
    return Shard(
        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(n, dim),
        np.frombuffer(row["orders"], np.int32), *wide,
    )


def _search(k: int):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = _read(row)
                out = [], [], []
                for own, vector in zip(row["query_ids"], row["queries"]):
                    places, scores, _ = shard.top(np.array(vector, dtype=np.int64), k, own)
                    out[0].extend([own] * len(places))
                    out[1].extend(shard.ids[places].tolist())
                    out[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return search


def quantised(vectors: DataFrame, scale: int = 1024, *, vec_id="vec_id", vector="embedding") -> DataFrame:
    """vec_id and the components as floor(scale * x), of vectors that are whole: no null or non-finite part."""
    column = F.col(vector)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(column.isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False)))
    return whole.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, *, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores over all rows but its own.

    Both tables hold vec_id and v (array of whole numbers); scores have to fit 64 bits. Ties go to the
    smaller vec_id. Vectors of other lengths count as filled up with zeros. A query that repeats is
    answered once (for its smallest vector), candidates that repeat each count. Without rows or
    queries the result is empty.
    """
    spark = rows.sparkSession
    ship(spark)
    index = kept(rows.select("vec_id", "v").mapInArrow(_shards(shard_rows), SHARD_SCHEMA), "impacts")
    asked = kept(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // query_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    grouped = asked.groupBy(block.alias("block")).agg(F.collect_list("vec_id").alias("query_ids"), F.collect_list("v").alias("queries"))
    # Pairs of shard and block are made of their names; the vectors join them afterwards.
    pairs = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    work = pairs.join(grouped, "block").join(index, "shard")
    found = work.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
