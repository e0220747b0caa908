"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fnv1a32, plain_words


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Zero if the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(0.0)


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Zero if either vector is zero or the lengths differ."""
    size = magnitude(a) * magnitude(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    m = magnitude(v)
    return F.when(m > 0, F.transform(v, lambda x: x.cast("double") / m)).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantize(v: Column) -> Column:
    """Bytes from -127 to 127, half away from zero."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") * 127))).cast("tinyint"))


def dot_bytes(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def class_pool(hidden: Column, dim: int) -> Column:
    """The first row of a flat matrix; zeros if there is none."""
    return F.when(F.size(hidden) >= dim, F.slice(hidden, 1, dim)).otherwise(F.array_repeat(F.lit(0.0), dim))


def mean_pool(rows: DataFrame, group: list[str], vector: str, mask: str | None = None) -> DataFrame:
    """The mean of the unmasked vectors of each group; zeros where all are masked."""
    keep = F.col(mask) != 0 if mask else F.lit(True)
    long = rows.select(*group, keep.alias("_keep"), F.posexplode(vector).alias("_pos", "_x"))
    means = long.groupBy(*group, "_pos").agg(F.coalesce(F.avg(F.when(F.col("_keep"), F.col("_x").cast("double"))), F.lit(0.0)).alias("_m"))
    # a group holds one row per dimension
    return means.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("pooled"))


def hash_embedding(text: Column, dim: int) -> Column:
    """Counts of hashed words over ``dim`` buckets, scaled to length one."""
    buckets = F.transform(plain_words(text), lambda w: (fnv1a32(w) % dim).cast("int"))
    counted = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(b, lambda x: x == d)).cast("double"))
    vector = F.get(F.transform(F.array(buckets), counted), F.lit(0))
    return F.get(F.transform(F.array(vector), l2_normalize), F.lit(0))


def _fnv(word: str) -> int:
    h = 2166136261
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def hash_vectors(docs: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    """(id, vector) as ``hash_embedding``, for many texts: words are hashed once per batch, in one stage without a shuffle."""
    words = docs.select(F.col(id_col).alias("id"), F.coalesce(plain_words(text), F.array().cast("array<string>")).alias("words"))
    out = T.StructType([*words.select("id").schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                column = part.column(1)
                sizes = np.asarray(column.value_lengths())
                coded = column.flatten().dictionary_encode()
                if len(known) > 500_000:
                    known = {}
                names = coded.dictionary.to_pylist()
                known.update((w, _fnv(w) % dim) for w in names if w not in known)
                bucket = np.array([known[w] for w in names], np.int64)[np.asarray(coded.indices)] if names else np.empty(0, np.int64)
                counts = np.bincount(np.repeat(np.arange(part.num_rows), sizes) * dim + bucket, minlength=part.num_rows * dim).reshape(-1, dim).astype(float)
                norm = np.sqrt((counts**2).sum(axis=1, keepdims=True))
                scaled = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.num_rows * dim + 1, dim, dtype=np.int32)), pa.array(scaled.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["id", "vector"])

    return words.mapInArrow(run, out)


def encode_vector(v: Column) -> Column:
    """The entries as little-endian 32-bit floats, one after the other."""
    return _codec("binary", lambda x: np.asarray(x, "<f4").tobytes())(v)


def decode_vector(data: Column) -> Column:
    """The inverse of ``encode_vector``; a rest of fewer than four bytes is left out."""
    return _codec("array<float>", lambda b: np.frombuffer(b, "<f4", len(b) // 4))(data)


def _codec(kind: str, one):  # noqa: ANN001, ANN202
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else one(x))

    return run
