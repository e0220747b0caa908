"""Toxicity by a classifier chain: linear models for one category after the other.

Each model sees the words of a text and the probabilities of the categories before it.  In training those
probabilities are out-of-fold predictions, so that a later model learns how far to trust them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 18
#: At most so many labelled documents are used to fit the models, and so many word buckets.
SAMPLE, SELECTED = 10_000, 512
FOLDS = 3
#: Letters of the beginning of a word.
STEM = 5
_WORD = re.compile(r"[^\W_]+")
#: Characters of a text whose words are found at once.
SLICE = 1 << 22


def word_buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of the lower-case words of a whole text, and of the beginnings of longer ones, sorted."""
    words: set[str] = set()
    text, at = text or "", 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end].isalnum():
            end += 1
        words.update(_WORD.findall(text[at:end].lower()))
        at = end
    words.update([w[:STEM] + "~" for w in words if len(w) > STEM])
    crc = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words))
    return np.unique(crc & np.uint32(BUCKETS - 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 2.0, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic regression, the last one the bias, by accelerated gradient steps."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    seen, n = w.copy(), max(1, len(y))
    # a step that is safe for the largest curvature, found with a few power iterations
    v = np.ones(x.shape[1], np.float32)
    for _ in range(10):
        v = x.T @ (x @ v)
        v /= max(float(np.linalg.norm(v)), 1e-9)
    step = 1 / (0.25 * (float(np.linalg.norm(x @ v)) ** 2 + n) / n + l2 / n)
    for k in range(rounds):
        r = _sigmoid(x @ seen[:-1] + seen[-1]) - y
        grad = np.append(x.T @ r + l2 * seen[:-1], r.sum()).astype(np.float32) / n
        new = seen - step * grad
        seen = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class Chain:
    """Models of the categories in order; weights are those of the selected buckets, earlier probabilities and the bias."""

    categories: tuple[str, ...]
    selected: np.ndarray
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]

    def probabilities(self, buckets: np.ndarray) -> list[float]:
        n, earlier = len(self.selected), []
        at = np.searchsorted(buckets, self.selected)
        hits = np.flatnonzero((at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == self.selected)) if len(buckets) else at[:0]
        for w in self.weights:
            z = float(w[hits].sum()) + sum(p * float(w[n + k]) for k, p in enumerate(earlier)) + float(w[-1])
            earlier.append(float(_sigmoid(np.float64(z))))
        return earlier


def fit_chain_rows(rows: list[tuple[int, list[int], list[int]]], selected: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """A chain from (id, selected buckets as positions, labels) rows."""
    rows = sorted(rows)
    x = np.zeros((len(rows), len(selected) + len(categories)), np.float32)
    y = np.array([r[2] for r in rows], np.float32).reshape(len(rows), len(categories))
    for i, r in enumerate(rows):
        x[i, r[1]] = 1
    fold = np.arange(len(rows)) % FOLDS
    weights, thresholds = [], []
    for c in range(len(categories)):
        own = x[:, : len(selected) + c]
        out = np.zeros(len(rows), np.float32)
        for k in range(FOLDS):
            w = _fit_linear(own[fold != k], y[fold != k, c])
            out[fold == k] = _sigmoid(own[fold == k] @ w[:-1] + w[-1])
        weights.append(_fit_linear(own, y[:, c]))
        thresholds.append(_best_threshold(out, y[:, c]))
        x[:, len(selected) + c] = out
    return Chain(categories, selected, tuple(weights), tuple(thresholds))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of largest F1 on out-of-fold predictions, in the middle of the gap."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(y)) + 1 + y.sum())
    k = int(np.argmax(f1))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(y) else 0)) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """Fit on the labelled documents, at most ``sample`` of them, chosen by a hash of their ids.

    ``categories`` gives a 0/1 expression over ``labels`` for each category, in the order of the chain.
    Buckets are selected by how far they separate each category, from counts that are added up before they
    are shuffled; the driver gets them and, per document, positions among at most SELECTED buckets.
    """
    names = tuple(categories)
    marked = labels.select(id_col, *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    one = marked.groupBy(id_col).agg(*[F.max(n).alias(n) for n in names])
    chosen = one.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    some = docs.select(id_col, text).join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *names)
    k = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS + 1, k + 1), np.int64)  # the last row is that of all documents
        for b in batches:
            marks = np.stack([np.asarray(b.column(2 + c)) for c in range(k)], 1) if b.num_rows else np.zeros((0, k))
            for t, m in zip(b.column(1).to_pylist(), marks):
                at = np.append(word_buckets(t), BUCKETS)
                sums[at, 0] += 1
                sums[at, 1:] += m.astype(np.int64)
        at = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(sums[at, c]) for c in range(k + 1)]], names=["bucket", "n", *names])

    counts = some.mapInArrow(count, ", ".join(["bucket bigint", "n bigint", *[f"{n} bigint" for n in names]]))
    counts = counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    got = np.array([tuple(r) for r in counts.filter("n >= 3").collect()], np.int64).reshape(-1, k + 2)
    whole = got[got[:, 0] == BUCKETS]
    if not len(whole):
        return Chain(names, np.empty(0, np.int64), tuple(np.zeros(c + 1, np.float32) for c in range(k)), (1.1,) * k)
    total, got = whole[0], got[got[:, 0] != BUCKETS]
    best: set[int] = set()
    for c in range(k):
        yes, no = max(1, total[2 + c]), max(1, total[1] - total[2 + c])
        p, q = got[:, 2 + c] / yes, (got[:, 1] - got[:, 2 + c]) / no
        spread = np.sqrt(np.maximum(got[:, 1] / total[1] * (1 - got[:, 1] / total[1]), 1e-9) * (1 / yes + 1 / no))
        score = np.abs(p - q) / spread
        best.update(got[np.lexsort((got[:, 0], -score))[: SELECTED // k], 0].tolist())
    selected = np.array(sorted(best), np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [np.flatnonzero(np.isin(selected, word_buckets(t), assume_unique=True)).tolist() for t in b.column(1).to_pylist()]
            marks = [list(m) for m in zip(*[b.column(2 + c).to_pylist() for c in range(k)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32()))], names=["doc_id", "hits", "marks"])

    placed = some.mapInArrow(place, "doc_id bigint, hits array<int>, marks array<int>")
    rows = placed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    return fit_chain_rows([(r[0], list(r[1]), list(r[2])) for r in rows], selected, names)


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (doc_id, if None), p_<category> for each category, and toxic for the last one's threshold.

    Whole texts are read, however long; a null or empty text has no words.  A probability that equals the threshold
    counts as toxic.  Rows are independent of each other, so repeated ones are scored alike and an empty table
    gives an empty result; columns of ``docs`` that aren't kept are not looked at.
    """
    picked = docs.select(*(keep or [F.col("doc_id")]), F.col(text).alias("_text"))
    out = T.StructType([*picked.schema.fields[:-1], *[T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories], T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [chain.probabilities(word_buckets(t.as_py())) for t in b.column(b.num_columns - 1)]
            cols = [pa.array([row[c] for row in p], pa.float64()) for c in range(len(chain.categories))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols, pa.array([row[-1] >= chain.thresholds[-1] for row in p], pa.bool_())], names=out.names)

    return picked.mapInArrow(run, out)
