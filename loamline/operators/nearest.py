"""Nearest vectors for many queries: exact, and a byte scan with exact rescoring.

Queries are taken in blocks; every task holds a block as a matrix, multiplies it with its vectors, and keeps
only the best rows of each query over all that it reads.  So a task writes at most ``keep`` rows for a query,
and pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept
from .lexical import DECIMALS, ranked

#: The largest block of queries, entries that a task keeps for a block, and vectors that are multiplied at once.
MOST_QUERIES, MOST_KEPT, STEP = 10_000, 2_000_000, 1024


def _quantized(m: np.ndarray) -> np.ndarray:
    """Bytes from -127 to 127, half away from zero, kept as floats so that products are exact and fast."""
    return np.clip(np.sign(m) * np.floor(np.abs(m) * 127 + 0.5), -127, 127)


class _Best:
    """The ``keep`` largest values of every query among the columns seen so far; of equal values the first ones."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.near, self.score = np.empty((queries, 0)), np.empty((queries, 0))
        self.place = np.empty((queries, 0), np.int64)

    def add(self, near: np.ndarray, score: np.ndarray, first: int) -> None:
        place = np.broadcast_to(np.arange(first, first + near.shape[1]), near.shape)
        near, score, place = (np.concatenate(x, axis=1) for x in ((self.near, near), (self.score, score), (self.place, place)))
        if near.shape[1] > self.keep:
            least = -np.partition(-near, self.keep - 1, axis=1)[:, self.keep - 1 : self.keep]
            more, same = near > least, near == least
            chosen = more | (same & (np.cumsum(same, axis=1) <= self.keep - more.sum(axis=1, keepdims=True)))
            near, score, place = (x[chosen].reshape(len(x), self.keep) for x in (near, score, place))
        self.near, self.score, self.place = near, score, place


def _scan_block(vectors: DataFrame, rows: list, kind: T.StructType, keep: int, quantized: bool) -> DataFrame:
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["vector"] or ()), []).append(r)
    blocks = [(size, pa.array([r["query_id"] for r in some]), np.array([r["vector"] for r in some], np.float64).reshape(len(some), size)) for size, some in by_size.items() if size or not quantized]
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(len(q), keep) for _, _, q in blocks]
        ids: pa.Array | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                column = part.column(1)
                lengths = np.asarray(column.value_lengths().fill_null(0))
                first = 0 if ids is None else len(ids)
                ids = part.column(0) if ids is None else pa.concat_arrays([ids, part.column(0)])
                for (size, _, q), own in zip(blocks, best):
                    # vectors of another length have cosine 0, and no product
                    near = np.full((len(q), part.num_rows), -np.inf if quantized else 0.0)
                    score = np.zeros_like(near)
                    fits = np.flatnonzero(lengths == size)
                    if size and len(fits):
                        v = np.asarray(column.take(pa.array(fits)).flatten(), np.float64).reshape(-1, size)
                        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                        score[:, fits] = np.divide(q @ v.T, norm, out=np.zeros_like(norm), where=norm > 0)
                        near[:, fits] = _quantized(q) @ _quantized(v).T if quantized else np.round(score[:, fits], DECIMALS)
                    own.add(near, score, first)
                if len(ids) > 4 * MOST_KEPT:  # let go of ids that no query holds any more
                    used = np.unique(np.concatenate([b.place.ravel() for b in best])) if best else np.empty(0, np.int64)
                    ids = ids.take(pa.array(used))
                    for b in best:
                        b.place = np.searchsorted(used, b.place)
        for (_, query_ids, _), own in zip(blocks, best):
            if ids is not None:
                row, col = np.nonzero(own.near > -np.inf)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(row)), ids.take(pa.array(own.place[row, col])), pa.array(own.near[row, col]), pa.array(own.score[row, col])], names=names)

    # in the order of ids, so that of equal values the first ones are those with the least ids
    return vectors.sortWithinPartitions("id").mapInArrow(run, kind)


def _scan(vectors: DataFrame, queries: DataFrame, keep: int, quantized: bool) -> DataFrame:
    """(query_id, id, near, score): of every task, the ``keep`` rows of the largest near values; ties go by id.

    ``near`` is the product of quantized vectors, or the rounded cosine.  Vectors of another length than the
    query's have no product, and cosine 0.  More queries than a block takes are searched block by block, and
    the results are stored, so the driver never holds more than a block.
    """
    kind = T.StructType([queries.schema["query_id"], vectors.schema["id"], T.StructField("near", T.DoubleType()), T.StructField("score", T.DoubleType())])
    vectors = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    most = max(1, min(MOST_QUERIES, MOST_KEPT // keep))
    out, block = None, []
    for row in queries.select("query_id", "vector").toLocalIterator(prefetchPartitions=True):
        if len(block) == most:
            done = kept(_scan_block(vectors, block, kind, keep, quantized), "nearest")
            out, block = done if out is None else out.unionByName(done), []
        block.append(row)
    last = _scan_block(vectors, block, kind, keep, quantized)
    return last if out is None else out.unionByName(last)


def nearest_exact(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, id, score, rank) by cosine; vectors without entries are left out, ties go by id."""
    some = vectors.filter(F.coalesce(F.size("vector"), F.lit(0)) > 0)
    if top <= 0:
        return ranked(_scan(some.limit(0), queries, 1, False).drop("near"), 0)
    return ranked(_scan(some, queries, top, False).drop("near"), top)


def nearest_rescored(vectors: DataFrame, queries: DataFrame, top: int, factor: int = 6) -> DataFrame:
    """As ``nearest_exact``, from the top * factor best of a scan over quantized vectors; ties of the scan go by id."""
    if top <= 0:
        return nearest_exact(vectors, queries, 0)
    pool = top * (factor if factor > 0 else 6)
    scanned = _scan(vectors.filter(F.col("vector").isNotNull()), queries, pool, True)
    order = Window.partitionBy("query_id").orderBy(F.col("near").desc(), F.col("id"))
    best = scanned.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pool)
    return ranked(best.select("query_id", "id", "score"), top)
