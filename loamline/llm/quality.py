"""Quality rules: text statistics and a learned decision list, in DataFrame operations only.

``text_statistics`` computes counts with built-in functions.  ``learn_decision_list`` fits ordered
conjunctions of thresholds by sequential covering on a bounded sample of labelled statistics (numbers, not
texts), and ``DecisionList.condition`` turns them into one Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: At most so many labelled documents are used to fit the list.
SAMPLE = 20_000


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_upper", "n_marks", "base_failed", "kept")


def _repeated_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text, the first one included; exact."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)
    window = lambda i: F.slice(words, i + 1, WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))
    # windows in the order of hash, words and position; equal ones are neighbours
    placed = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(window(i)).alias("h"), window(i).alias("w"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda a, b: F.coalesce((F.get(s, a)["h"] == F.get(s, b)["h"]) & (F.get(s, a)["w"] == F.get(s, b)["w"]), F.lit(False))
        last = F.size(s) - 1
        twice = F.filter(
            F.transform(F.sequence(F.lit(0), last), lambda k: F.when(((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(k, F.least(k + 1, last))), F.get(s, k)["i"])),
            lambda i: i.isNotNull(),
        )
        spans = lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
        )
        return let(F.array_sort(twice), spans)

    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= WINDOW, 0).when(repeats, let(placed, covered)).otherwise(0)


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if None) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_stutter (words equal to the one before), n_upper and n_marks.

    A null text has no words.  Everything is counted within a row, over the whole text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    cols = [F.col(c) for c in (docs.columns if keep is None else keep) if c not in STATISTICS]
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    stats = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeated_words(w).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(F.transform(w, lambda x, i: x == F.get(w, i - 1)), lambda same: same)).cast("bigint").alias("n_stutter"),
        ),
    )
    return docs.select(
        *cols,
        stats.alias("_stats"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count(body, F.lit(r"[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count(body, F.lit(r"[!?]")).cast("bigint").alias("n_marks"),
    ).select(*cols, "_stats.*", "n_symbols", "n_dup_lines", "n_upper", "n_marks")


#: What the rules may look at: ratios of the counts.
FEATURES: dict[str, Column] = {}


def features() -> dict[str, Column]:
    if not FEATURES:
        words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
        chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
        FEATURES.update(
            words=F.col("n_words").cast("double"),
            word_length=F.col("word_chars") / words,
            symbols=F.col("n_symbols") / words,
            dup_lines=F.col("n_dup_lines").cast("double"),
            repeats=F.col("n_repeat_words") / words,
            stutter=F.col("n_stutter") / words,
            upper=F.col("n_upper") / chars,
            marks=F.col("n_marks") / words,
        )
    return FEATURES


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_at_least, threshold) conditions under which a document is rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def matches(self, row: dict[str, float]) -> bool:
        return all((row[f] >= t) if least else (row[f] < t) for f, least, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for f, least, t in self.conditions:
            out = out & ((features()[f] >= t) if least else (features()[f] < t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if least else '<'} {t:.6g}" for f, least, t in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def condition(self) -> Column:
        """True for a document that no rule rejects: one conditional expression in the order of the rules."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
        return F.lit(True) if out is None else out.otherwise(True)

    def keeps(self, row: dict[str, float]) -> bool:
        return not any(r.matches(row) for r in self.rules)


def _best_cut(values: np.ndarray, bad: np.ndarray) -> tuple[float, bool, float] | None:
    """(gain, is_at_least, threshold) of the best condition on one feature, over all cuts half-way between distinct values."""
    order = np.argsort(values, kind="stable")
    v, b = values[order], np.cumsum(bad[order])
    ends = np.flatnonzero(v[1:] > v[:-1])  # the last row below each cut
    if not len(ends):
        return None
    base = math.log2(b[-1] / len(v))
    best = None
    below_bad, below = b[ends].astype(float), ends + 1.0
    for least, p, n in ((True, b[-1] - below_bad, len(v) - below), (False, below_bad, below)):
        gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - base), -np.inf)
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), least, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return best


def _grow(bad: list[dict], good: list[dict], names: list[str]) -> Rule:
    """Add the condition of largest information gain until no good row is left."""
    rows = bad + good
    table = {f: np.array([r[f] for r in rows], float) for f in names}
    marks = np.array([True] * len(bad) + [False] * len(good))
    rule: list[tuple[str, bool, float]] = []
    while len(marks) and not marks.all():
        found = [(f, cut) for f in names if (cut := _best_cut(table[f], marks))]
        if not found:
            break
        f, (gain, least, t) = max(found, key=lambda x: x[1][0])
        if gain <= 1e-12:
            break
        rule.append((f, least, t))
        keep = table[f] >= t if least else table[f] < t
        table, marks = {g: x[keep] for g, x in table.items()}, marks[keep]
    return Rule(tuple(rule))


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[Rule, float, int]:
    """Cut final conditions where that raises (p - n) / (p + n) on rows not grown on; with its precision there."""
    best = (rule, -2.0, 0.0, 0)
    for k in range(len(rule.conditions), 0, -1):
        r = Rule(rule.conditions[:k])
        p, n = sum(map(r.matches, bad)), sum(map(r.matches, good))
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1]:
            best = (r, worth, p / (p + n) if p + n else 0.0, p)
    return best[0], best[2], best[3]


def learn_decision_list(rows: list[tuple[int, bool, dict[str, float]]], least_precision: float = 0.98, least_cover: int = 3) -> DecisionList:
    """Sequential covering over (id, is_good, features) rows.

    Two thirds of the rows grow a rule, the rest prune it.  A rule enters the list if, on the pruning rows,
    it covers ``least_cover`` bad rows with ``least_precision``; bad rows that it covers then leave, and the first
    rule that fails ends the list.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    names = list(rows[0][2]) if rows else []
    part = lambda k: [r for i, r in enumerate(rows) if (i % 3 == 0) == k]
    grow_bad, grow_good = [r[2] for r in part(False) if not r[1]], [r[2] for r in part(False) if r[1]]
    prune_bad, prune_good = [r[2] for r in part(True) if not r[1]], [r[2] for r in part(True) if r[1]]
    rules: list[Rule] = []
    while grow_bad and prune_bad:
        rule, precision, cover = _prune(_grow(grow_bad, grow_good, names), prune_bad, prune_good)
        if not rule.conditions or precision < least_precision or cover < least_cover:
            break
        rules.append(rule)
        grow_bad = [r for r in grow_bad if not rule.matches(r)]
        prune_bad = [r for r in prune_bad if not rule.matches(r)]
    return DecisionList(tuple(rules))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DecisionList:
    """A decision list from the labelled documents, of which at most ``sample`` are used.

    The labels are chosen by a hash of their ids before any text is read; the driver gets one row of eight
    numbers for each.  Rows without id or label are left out; no usable label gives an empty list.  Of several
    labels of one id the least counts; whole texts of any length are read.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    chosen = one.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    texts = docs.select(id_col, text).join(F.broadcast(chosen), id_col)
    got = text_statistics(texts, text, [id_col, "quality"]).select(id_col, "quality", *[c.alias(n) for n, c in features().items()])
    got = got.orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    return learn_decision_list([(r[0], bool(r[1]), {n: r[n] for n in features()}) for r in got])


def judge_quality(docs: DataFrame, rules: DecisionList, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None), the statistics, base_failed and kept for every row of ``docs``.

    Kept columns named like a statistic give way to it.  Repeated rows are judged each; an empty table gives an
    empty result; a null or blank text has no words and fails.
    """
    stats = text_statistics(docs, text, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.condition())


def drop_poor(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, also where their names are those of statistics."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return judge_quality(whole, rules, "_text", ["_row"]).filter("kept").select("_row.*")
