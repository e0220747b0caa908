"""Near copies by SimHash and meet-in-the-middle balls, verified by the Jaccard similarity of five-word shingle sets.

Two texts at the limit of 0.8 differ in about ten of 64 bits, which no ball that can be written out reaches.  So
a shingle set has many independent fingerprints, and of each fingerprint two keys, the low bits of its two
halves.  Around every key lies the ball of radius one; balls of two sets meet if the keys differ in two bits or
fewer, which a pair at the limit does in one key of seven at least.  ``plan`` takes so many keys that no more
than MISSED of such pairs meet in none of them.  Sets that meet are compared on all bits of two fingerprints, and
what is left shares a bucket and is verified on the whole shingle sets (minhash.similar_links).

Balls aren't shuffled: a key is sent to the task of its first bits and to those of the first bits with one of
them flipped, and the flips of the other bits are made there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, staged
from .minhash import first_of_groups, signatures, similar_links
from .simhash import SEED

#: The share of pairs at the limit that meet in no key, and the share of bits in which they differ at most: sets
#: of four and five shingles with four in common differ in 0.1875, all others in 0.162 or fewer.
MISSED, DIFFER = 5e-5, 0.1875
#: Sets that meet go on if they differ in at most this many of 128 bits; unlike ones differ in half of them.
CLOSE = 32
#: Sets that meet in one point are compared up to this number; more go on uncompared.
DENSE = 64
_LANES = np.uint64(0x0101010101010101)


def _within(n: int, most: int) -> float:
    return sum(comb(n, k) * DIFFER**k * (1 - DIFFER) ** (n - k) for k in range(most + 1))


def plan(n: int) -> tuple[int, int, int]:
    """Bits of a key, number of fingerprints and bits that name a task, for ``n`` documents.

    Keys grow with the logarithm of ``n``, so that unlike sets seldom meet, and so do the first bits, so that
    a task's part of a key holds at most about 2 ** 18 balls.
    """
    size = max(n, 2).bit_length()
    bits = min(32, max(24, size + 3))
    met = _within(bits, 2) * _within(128 - bits, CLOSE - 2)
    return bits, ceil(log(MISSED) / log(1 - met) / 2), max(2, size - 17)


def fingerprints(sets: list[np.ndarray], m: int) -> np.ndarray:
    """``m`` independent SimHash fingerprints of 64 bits of each shingle set, one row a set."""
    own = np.concatenate(sets)
    sizes = np.array([len(x) for x in sets])
    first = np.cumsum(sizes) - sizes
    # one bit of each byte is counted in that byte, in pieces of 255 hashes at most
    starts = np.concatenate([np.arange(f, f + n, 255) for f, n in zip(first, sizes)])
    piece = np.searchsorted(starts, first)
    out = np.empty((len(sets), m), np.uint64)
    ones = np.empty((len(sets), 8, 8), np.int64)
    for j in range(m):
        x = own + np.uint64((SEED + (j + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for b in range(8):
            counts = np.add.reduceat(x >> np.uint64(b) & _LANES, starts).view(np.uint8).reshape(-1, 8)
            ones[:, :, b] = np.add.reduceat(counts, piece, axis=0, dtype=np.int64)
        out[:, j] = np.packbits(2 * ones.reshape(-1, 64) > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _keys(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    return x >> np.uint64(32 * (key % 2)) & np.uint64((1 << bits) - 1)


def _sent(bits: int, m: int, first: int):
    """(part, rows): for each key and each first bits, the sets that have them or have one of them flipped, 24 bytes a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0)).view(np.uint64)
            fps = np.asarray(b.column(1).flatten()).view(np.uint64).reshape(-1, m)
            for key in range(2 * m):
                j = key // 2
                rows = np.stack([ids, fps[:, j], fps[:, (j + 1) % m]], 1)
                own = _keys(fps[:, j], key, bits) >> np.uint64(bits - first)
                sent = [rows[np.bitwise_count(own ^ np.uint64(p)) <= 1].tobytes() for p in range(1 << first)]
                parts = pa.array(range(key << first, (key + 1) << first), pa.int64())
                yield pa.RecordBatch.from_arrays([parts, pa.array(sent, pa.binary())], names=["part", "rows"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def meeting(rows: np.ndarray, part: int, bits: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, set): the sets of one part whose balls meet in a point and that are close to another one there.

    A bucket is named by its members, so points with the same members make one.
    """
    ids, x, y = (np.ascontiguousarray(rows[:, k]) for k in range(3))
    key = _keys(x, part >> first, bits)
    rest = bits - first
    inner = key & np.uint64((1 << rest) - 1)
    own = np.flatnonzero(key >> np.uint64(rest) == np.uint64(part & (1 << first) - 1))
    point, at = [inner], [np.arange(len(ids), dtype=np.uint64)]
    for k in range(rest):
        point.append(inner[own] ^ np.uint64(1 << k))
        at.append(own.astype(np.uint64))
    both = np.concatenate(point) << np.uint64(32) | np.concatenate(at)
    both.sort()
    point, at = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.concatenate([[True], point[1:] != point[:-1]])
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(point)))
    group = np.repeat(np.arange(len(start)), size)
    close = np.repeat(size > DENSE, size)
    # each member with the one k places on
    left, k = np.flatnonzero(np.repeat((size > 1) & (size <= DENSE), size)), 0
    while len(left):
        k += 1
        left = left[left + k < len(point)]
        left = left[point[left + k] == point[left]]
        a, b = at[left], at[left + k]
        hit = left[np.bitwise_count(x[a] ^ x[b]).astype(np.int64) + np.bitwise_count(y[a] ^ y[b]) <= CLOSE]
        close[hit] = close[hit + k] = True
    group, at = group[close], at[close]
    if not len(group):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    bucket = _mixed(np.add.reduceat(_mixed(ids[at]), start))
    once = np.zeros(len(start), bool)
    once[np.unique(bucket, return_index=True)[1]] = True
    keep = np.repeat(once, size)
    return np.repeat(bucket, size)[keep], ids[at][keep]


def _met(bits: int, first: int):
    """(bucket, set) of all parts of a task; the rows come sorted by part."""

    def found(part: int, held: list[bytes]) -> pa.RecordBatch:
        bucket, own = meeting(np.frombuffer(b"".join(held), np.uint64).reshape(-1, 3), part, bits, first)
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(own.view(np.int64))], names=["bucket", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for k in range(b.num_rows):
                p = b.column(0)[k].as_py()
                if p != part and held:
                    yield found(part, held)
                    held = []
                part = p
                held.append(b.column(1)[k].as_py())
        if held:
            yield found(part, held)

    return run


def ball_members(sets: DataFrame, bits: int, m: int, first: int) -> DataFrame:
    """(bucket, set) of sets that meet, from ``sets`` with set (once each) and marks, its ``m`` fingerprints."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sets.select("set", "marks").mapInArrow(_sent(bits, m, first), "part bigint, rows binary").filter(F.length("rows") > 0)
    met = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_met(bits, first), "bucket bigint, set bigint")
    return met.distinct()


def drop_near(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the smallest id stays.

    A group is what links of a similarity of 0.8 or more connect; a link is missed with a probability of at
    most MISSED.  Null texts count as empty, null ids as larger than any other; of rows equal in id and text
    one stays.
    """
    bits, m, first = plan(docs.count())
    marks = staged(signatures(docs, text, row_key(text, id_col), lambda sets: fingerprints(sets, m), m), "signatures")
    sets = marks.groupBy("set").agg(F.first("marks").alias("marks"))
    member = staged(ball_members(sets, bits, m, first), "members")
    return first_of_groups(docs, marks, similar_links(docs, marks, member, text, id_col), text, id_col)
