"""Near copies by the Jaccard similarity of five-word shingle sets.

Candidates come in buckets, here from MinHash (the pipeline takes those of SimHash balls, see near_balls): sets
that agree in all ROWS minima of one of BANDS bands share a bucket.  A pair at the limit of 0.8 is missed with
a probability of (1 - 0.8 ** 5) ** 25, about one in 20,000, and a closer one more rarely.  Every candidate is
then verified on the whole shingle sets, so no pair below the limit is ever linked.  Buckets of any size are
worked off without writing out their pairs: every member is compared with one other, then a few members (centres)
with the others of their bucket, what that links leaves the work, and where a bucket still holds more than one
component, more centres follow, four times as many in each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, semi_by_key, staged
from .simhash import SEED, _words, components

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 25, 5
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_TIMES, _PLUS = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the five-word shingles of a text, sorted; a shorter text is one shingle, a blank one too."""
    held: list[bytes] = []
    parts: list[np.ndarray] = []
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        held = held[-(SHINGLE - 1) :] + words if parts else held + words
        m = len(held) - SHINGLE + 1
        if m > 0:
            parts.append(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(held[k:] for k in range(SHINGLE)))), repeat(SEED)), "<u8", m))
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], "<u8")
    return np.unique(np.concatenate(parts))


def bands(own: np.ndarray) -> np.ndarray:
    """One hash for each band of minima of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        np.minimum(least, (own[at : at + 2048, None] * _TIMES + _PLUS).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


#: Shingles that are held at once to take their marks.
HELD = 1 << 16


def signatures(docs: DataFrame, text: str, keys: list, marks_of: Callable[[list[np.ndarray]], np.ndarray], width: int) -> DataFrame:
    """``keys``, the id of the shingle set (its hash) and its marks, ``width`` numbers of 64 bits, for every row."""
    picked = docs.select(*keys, F.col(text).alias("_text"))
    out = picked.drop("_text").withColumns({"set": F.lit(0).cast("bigint"), "marks": F.array().cast("array<bigint>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = np.empty(b.num_rows, np.uint64), np.empty((b.num_rows, width), np.uint64)
            held, n = [], 0
            for k, t in enumerate(b.column(b.num_columns - 1)):
                held.append(shingles(t.as_py()))
                n += len(held[-1])
                ids[k] = xxhash.xxh64_intdigest(held[-1].tobytes(), SEED)
                if n >= HELD or k + 1 == b.num_rows:
                    marks[k + 1 - len(held) : k + 1] = marks_of(held)
                    held, n = [], 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * width + 1, width, dtype=np.int32)), pa.array(marks.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids.view(np.int64)), lists], names=out.names)

    return picked.mapInArrow(run, out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar enough; rows come sorted by a, whose shingles are taken once."""
    last, x = None, np.empty(0, np.uint64)
    for batch in batches:
        keep = []
        for k in range(batch.num_rows):
            a = batch.column(0)[k].as_py()
            if a != last:
                last, x = a, shingles(batch.column(2)[k].as_py())
            keep.append(jaccard(x, shingles(batch.column(3)[k].as_py())) >= SIMILAR)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])


def similar_links(docs: DataFrame, marks: DataFrame, member: DataFrame, text: str, id_col: str) -> DataFrame:
    """(a, b) pairs of shingle sets with a similarity of SIMILAR or more that connect what all candidates connect.

    ``marks`` holds the shingle set of every row with the hash of its text as ``_k_sha``, ``member`` (stored) the
    sets of each bucket, once; all pairs within a bucket are candidates.
    """
    sha = row_key(text, id_col)[1]
    ends = member.groupBy("bucket").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).filter("lo <> hi")
    buckets = staged(member.join(ends, "bucket"), "buckets")
    sets = marks.groupBy("set").agg(F.min("_k_sha").alias("_k_sha")).join(buckets.select("set").distinct(), "set", "left_semi")
    texts = docs.select(sha, F.col(text).alias("text")).join(sets, "_k_sha").select("set", "text").dropDuplicates(["set"])
    texts = staged(texts, "candidate-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        rows = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
        return staged(rows.mapInArrow(_verify, "a bigint, b bigint"), "similar")

    # each set with the least one that it shares a bucket with
    tried = buckets.filter("set <> lo").groupBy("set").agg(F.min("lo").alias("a")).select("a", F.col("set").alias("b"))
    tried = staged(tried, "pairs")
    links = verified(tried)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # members that were no centre yet; centres are through with their bucket
    left, many = buckets.select("bucket", "set"), 4
    while True:
        comp = components(links)
        rooted = left.join(comp, left["set"] == comp["node"], "left").select("bucket", "set", F.coalesce("root", "set").alias("root"))
        split = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
        left = staged(rooted.join(split, "bucket"), "open-buckets")
        if left.isEmpty():
            return links
        order = Window.partitionBy("bucket").orderBy(F.xxhash64("set"), "set")
        centres = left.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= many).select("bucket", F.col("set").alias("centre"), F.col("root").alias("own"))
        centres = staged(centres, "centres")
        pairs = left.join(centres, "bucket").filter("root <> own").select(*pair("set", "centre")).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        links = staged(links.unionByName(verified(pairs)), "links")
        left = left.select("bucket", "set").join(centres.select("bucket", F.col("centre").alias("set")), ["bucket", "set"], "left_anti")
        many *= 4


def first_of_groups(docs: DataFrame, marks: DataFrame, links: DataFrame, text: str, id_col: str) -> DataFrame:
    """Of the rows whose shingle sets are connected by links the one with the smallest id; ``marks`` has _k_id, _k_sha and set."""
    key_id, key_sha = row_key(text, id_col)
    comp = components(links)
    rooted = marks.join(comp, marks["set"] == comp["node"], "left").select("_k_id", "_k_sha", F.coalesce("root", "set").alias("root"))
    first = F.min(F.struct(F.col("_k_id").isNull().alias("none"), "_k_id", "_k_sha"))
    stays = rooted.groupBy("root").agg(first.alias("s")).select("s._k_id", "s._k_sha")
    return semi_by_key(docs, stays, {"_k_id": key_id, "_k_sha": key_sha}, text)


def drop_similar(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the smallest id stays.

    A group is what links of a similarity of SIMILAR or more connect.  Null ids count as larger than any
    other; of rows equal in id and text one stays.
    """
    marks = staged(signatures(docs, text, row_key(text, id_col), lambda sets: np.stack([bands(own) for own in sets]), BANDS), "signatures")
    sets = marks.groupBy("set").agg(F.first("marks").alias("marks"))
    member = staged(sets.select("set", F.explode("marks").alias("bucket")).distinct(), "members")
    return first_of_groups(docs, marks, similar_links(docs, marks, member, text, id_col), text, id_col)
