"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within three bits differ somewhere in one of four 16-bit blocks, if they differ at all.
With that block masked out they are within two bits, so the balls of radius one around both meet.  Every
distinct fingerprint emits, for each of the four masks, itself and its 48 variants of one flipped bit; the
variants are shuffled, and fingerprints that meet are verified on all 64 bits.  Balls of radius two
around the unmasked 64 bits, which the odd radius of three would ask for, hold 2,081 variants instead of
196 and miss the shuffle budget by far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, row_key, semi_by_key, staged

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Characters of a text that are split into words at once.
SLICE = 1 << 22


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the three-word shingles of a text, as an unsigned integer."""
    held: list[bytes] = []
    ones, n = np.zeros(64, np.int64), 0
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        held = held[-(SHINGLE - 1) :] + words if n else held + words
        if len(held) < SHINGLE:
            continue
        m = len(held) - SHINGLE + 1
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(held, held[1:], held[2:])), repeat(SEED)), "<u8", m)
        for at in range(0, m, 1 << 14):
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += m
    if not n:
        if not held:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keys: list | None = None) -> DataFrame:
    """``keys`` and fp (bigint with the bits of the fingerprint) of every row; a null text counts as empty."""
    keys = keys or [F.col("doc_id")]
    picked = docs.select(*keys, F.col(text).alias("_text"))
    out = picked.drop("_text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=out.names)

    return picked.mapInArrow(run, out)


_BLOCKS = [0xFFFF << s for s in (0, 16, 32, 48)]
#: (kept bits, bits to flip) of each of the 196 variants: a mark of the mask in the masked block, and up to one flip outside.
_VARIANTS = [(~b & (1 << 64) - 1, (t + 1) << 16 * t ^ flip) for t, b in enumerate(_BLOCKS) for flip in [0] + [1 << i for i in range(64) if not b >> i & 1]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variant(fp: Column, code: Column) -> Column:
    keep, flip = (F.array(*[F.lit(_signed(v[k])).cast("bigint") for v in _VARIANTS]) for k in (0, 1))
    return fp.bitwiseAND(F.get(keep, code)).bitwiseXOR(F.get(flip, code))


def _near(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within RADIUS bits that connect the distinct fingerprints of one variant as all its links do.

    Each fingerprint not yet reached is compared with all that are still open, and what it reaches leaves
    the open ones, so the links found are at most as many as the fingerprints.
    """
    open_ = np.unique(group)
    while len(open_):
        front, open_ = open_[:1], open_[1:]
        while len(front) and len(open_):
            one, front = front[0], front[1:]
            hit = np.bitwise_count(open_ ^ one) <= RADIUS
            if hit.any():
                found = open_[hit]
                yield np.full(len(found), one), found
                front, open_ = np.concatenate([front, found]), open_[~hit]


#: Groups of one variant up to this size compare fingerprints with each other, larger ones look up their neighbours.
DENSE = 4096
_OFFSETS = [np.array([x for x in range(1 << 16) if x.bit_count() <= k], np.int64) for k in range(RADIUS + 1)]


def _near_dense(group: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_near`` for the fingerprints of one variant and mask, in time that grows with their number only.

    Outside the masked block they take few values (the variant and its one-bit flips), so members are
    found by that value and the block's 16 bits; labels fall to the least member in reach.
    """
    f = np.unique(group)
    shift = np.uint64(16 * mask)
    inner = ((f >> shift) & np.uint64(0xFFFF)).astype(np.int64)
    outer, row = np.unique(f & ~(np.uint64(0xFFFF) << shift), return_inverse=True)
    table = np.full((len(outer), 1 << 16), -1, np.int64)
    table[row, inner] = np.arange(len(f))
    label = np.arange(len(f))
    while True:
        new = label.copy()
        for a in range(len(outer)):
            mine = np.flatnonzero(row == a)
            for b in range(len(outer)):
                left = RADIUS - int(np.bitwise_count(outer[a] ^ outer[b]))
                for x in _OFFSETS[left] if left >= 0 else ():
                    near = table[b, inner[mine] ^ x]
                    hit = near >= 0
                    new[mine[hit]] = np.minimum(new[mine[hit]], label[near[hit]])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    if len(f):
        yield f[label], f


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each variant; the rows come sorted by variant."""
    held_v, held_f, held_m = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8)

    def links(v: np.ndarray, f: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(v[1:] != v[:-1]) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(v)]])
        many = np.flatnonzero(ends - starts > 1)
        two = many[ends[many] - starts[many] == 2]
        a, b = [f[starts[two]]], [f[starts[two] + 1]]
        close = np.bitwise_count(a[0] ^ b[0]) <= RADIUS
        a, b = [a[0][close]], [b[0][close]]
        for k in many[ends[many] - starts[many] > 2].tolist():
            at = slice(starts[k], ends[k])
            found = _near(f[at]) if ends[k] - starts[k] <= DENSE else (p for t in range(len(_BLOCKS)) for p in _near_dense(f[at][mask[at] == t], t))
            for x, y in found:
                a.append(x)
                b.append(y)
        x, y = np.concatenate(a), np.concatenate(b)
        keep = x != y
        x, y = x[keep], y[keep]
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))], names=["a", "b"])

    for batch in batches:
        v = np.concatenate([held_v, np.asarray(batch.column(0))])
        f = np.concatenate([held_f, np.asarray(batch.column(1)).view(np.uint64)])
        m = np.concatenate([held_m, np.asarray(batch.column(2))])
        if not len(v):
            continue
        last = int(np.searchsorted(v, v[-1]))  # the last variant may go on in the next batch
        if last:
            yield from links(v[:last], f[:last], m[:last])
        held_v, held_f, held_m = v[last:], f[last:], m[last:]
    if len(held_v):
        yield from links(held_v, held_f, held_m)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b) pairs of different fingerprints within three bits that connect what all such pairs connect.

    ``fps`` holds distinct fingerprints.  A variant gathers at most the fingerprints that differ from it in
    its masked block and one more bit, whatever the number of documents.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = F.array(*[F.lit(k).cast("short") for k in range(len(_VARIANTS))])
    v = fps.repartition(n, "fp").select("fp", F.explode(codes).alias("code"))
    # only (fp, code) is shuffled; the variant is computed before and after
    v = v.repartition(n, _variant(F.col("fp"), F.col("code")))
    v = v.select(_variant(F.col("fp"), F.col("code")).alias("v"), "fp", (F.col("code") / (len(_VARIANTS) // len(_BLOCKS))).cast("tinyint").alias("mask"))
    return v.sortWithinPartitions("v").mapInArrow(_meet, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node reachable, for every node of an edge, by alternating large and small stars.

    Every round is a shuffle of at most the edges, written to the shared folder; a star's centre keeps only
    links to the smallest neighbour, so the work doesn't grow with the size of a component.  Rounds go on
    until nothing changes, about as often as the logarithm of a component's size.
    """
    edges = staged(edges, "links")
    total = None
    while True:
        # large star: link every larger neighbour of a node to the smallest node around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        # small star: link the smaller neighbours of a node and the node to the smallest of them
        down = large.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = staged(small.filter(F.col("a") != F.col("b")).distinct(), "links")
        # done when every node has one link and no root has one upwards; the sum goes down until then
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == total:
            break
        total = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keys: list | None = None) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of three bits or fewer.

    Null and blank texts have fingerprint zero and are linked like others.  Null ids count as larger than
    any other.  One row per row of ``docs``, repeated ones too; an empty table gives an empty result.
    """
    marks = staged(fingerprints(docs, text, [F.col(id_col).alias("doc_id"), *(keys or [])]), "fingerprints")
    least = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct-fingerprints")
    comp = components(fingerprint_links(least.select("fp")))
    rooted = least.join(comp, least["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return join_frequent(marks, classes, ["fp"], least)


def drop_near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the smallest id stays."""
    key_id, key_sha = row_key(text, id_col)
    groups = near_groups(docs, text, id_col, [key_sha])
    stays = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_k_id"), "_k_sha")
    return semi_by_key(docs, stays, {"_k_id": key_id, "_k_sha": key_sha}, text)
