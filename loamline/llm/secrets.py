"""Secret scans in DataFrame operations only: three patterns, and sliding-window entropy for the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Candidates for the entropy scan: maximal runs that are long and hold a digit and a letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{24,}"
WINDOW = 24
#: Character classes, the narrower first, and the least entropy in bits that a window must have.
CLASSES = (("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.2), ("any", r"^.+$", 3.7))
#: The signs of candidates; counts of a window are kept in fields of BITS bits, FIELDS of them in a number.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BITS, FIELDS = 5, 12
#: Never secrets: UUIDs; words and short numbers put together with separators; what is too short without its placeholders.
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
SEPARATORS, PLAIN_PART = "[-_/=]", "^[A-Za-z]*[0-9]{0,4}$"
PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|sample|redacted|x{6}|0{8}|1234567|abcdef"
#: c * log2(c) for counts within a window, in millionths, so that sums are exact.
PARTS = [0] + [round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 1)]


def _limit(bits: float) -> int:
    """The largest sum of PARTS of a window whose entropy is at least ``bits``."""
    return math.floor(1e6 * WINDOW * (math.log2(WINDOW) - bits))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, found) of the leftmost matches that don't overlap; start in code points."""
    none = F.array().cast("array<struct<start:bigint,found:string>>")

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, g: (F.length(f) + F.length(g)).cast("bigint"))
        return F.zip_with(found, running(sizes, lambda a, x: a + x), lambda f, end: F.struct((end - F.length(f)).alias("start"), f.alias("found")))

    return F.when(
        text.rlike(pattern),
        let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))),
    ).otherwise(none)


def least_parts(candidate: Column) -> Column:
    """The smallest sum of c * log2(c) over all windows of a candidate, in millionths.

    One fold over the signs: the counts of the window are fields of a few numbers, and its sum changes by the
    counts of the sign that enters and of the one that leaves.
    """
    part = lambda c: F.get(F.array(*map(F.lit, PARTS)), c)
    words = -(-len(SIGNS) // FIELDS)
    state = "struct<counts:array<bigint>,sum:bigint,least:bigint>"

    def step(s: Column, x: Column) -> Column:
        field = lambda counts, q: F.call_function("shiftright", F.get(counts, (q / FIELDS).cast("int")), (q % FIELDS * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        unit = lambda q: F.call_function("shiftleft", F.lit(1).cast("bigint"), (q % FIELDS * BITS).cast("int"))
        at = lambda q, i: (q / FIELDS).cast("int") == i

        def leave(counts: Column) -> Column:
            left = F.transform(counts, lambda w, i: w - F.when(at(x["gone"], i), unit(x["gone"])).otherwise(F.lit(0)))
            return F.when(
                x["gone"].isNotNull(), let(field(counts, x["gone"]), lambda n: F.struct(left.alias("counts"), (part(n - 1) - part(n)).cast("bigint").alias("change")))
            ).otherwise(F.struct(counts.alias("counts"), F.lit(0).cast("bigint").alias("change")))

        def enter(now: Column) -> Column:
            counts = F.transform(now["counts"], lambda w, i: w + F.when(at(x["come"], i), unit(x["come"])).otherwise(F.lit(0)))
            total = let(field(now["counts"], x["come"]), lambda n: s["sum"] + now["change"] + part(n + 1) - part(n))
            return let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.when(x["full"], F.least(s["least"], t)).otherwise(s["least"]).alias("least")).cast(state))

        return let(leave(s["counts"]), enter)

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SIGNS), c) - 1)
    steps = lambda q: F.transform(q, lambda c, i: F.struct(c.alias("come"), F.when(i >= WINDOW, F.get(q, i - WINDOW)).alias("gone"), (i >= WINDOW - 1).alias("full")))
    begin = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(1 << 40).cast("bigint").alias("least")).cast(state)
    return F.aggregate(let(codes, steps), begin, step)["least"]


def allowed(candidate: Column) -> Column:
    """Whether a candidate is on the allow-list: a placeholder word takes away only the part that holds it."""
    parts = F.split(candidate, SEPARATORS)
    holds = lambda p: p.rlike(PLACEHOLDER)
    rest = F.aggregate(F.filter(parts, lambda p: ~holds(p)), F.lit(0).cast("bigint"), lambda n, p: n + F.length(p))
    return candidate.rlike(UUID) | (candidate.rlike(SEPARATORS) & F.forall(parts, lambda p: p.rlike(PLAIN_PART))) | (candidate.rlike(PLACEHOLDER) & F.exists(parts, holds) & (rest < WINDOW))


def looks_random(candidate: Column) -> Column:
    limit = F
    for _, pattern, bits in CLASSES:
        limit = limit.when(candidate.rlike(pattern), _limit(bits))
    return ~allowed(candidate) & (least_parts(candidate) <= limit)


def _without_overlaps(spans: Column) -> Column:
    """Sorted spans without entropy ones that a pattern's span overlaps: by the furthest end before and the next start behind."""
    most = lambda a, x: F.greatest(a, x)
    far = F.lit(-(1 << 40)).cast("bigint")
    reach = running(F.transform(spans, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(far)), most)
    # from the end: starts with the sign turned, so that the next one is the largest
    ahead = running(F.transform(F.reverse(spans), lambda s: F.when(s["rank"] < 3, -s["start"]).otherwise(far)), most)
    keep = lambda r, a: F.filter(spans, lambda s, i: (s["rank"] < 3) | ((F.get(r, i) <= s["start"]) & (-F.get(a, F.size(spans) - 1 - i) >= s["end"])))
    return let(reach, lambda r: let(ahead, lambda a: keep(r, a)))


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) and spans: array of (start, rank, kind, end), by start and rank of the kind.

    Kinds, in order: assign, access and hex (patterns) and entropy.  Spans count code points, ends are
    exclusive.  An entropy span is a whole candidate; it's left out where a pattern's span overlaps it.  A
    null or empty text has no spans, an empty table gives an empty result, repeated rows are scanned each, and
    spans that start together are ordered by kind.  Time grows with the length of a text, and with the number of its
    spans to the power of 1.5.  A column of ``docs`` named spans is replaced; others stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    span = lambda rank, kind: lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["found"])).alias("end")
    )
    cols = [F.col(c) for c in (docs.columns if keep is None else keep) if c != "spans"]

    def all_spans(t: Column) -> Column:
        assign = F.filter(matches(t, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6)
        # runs that are long enough are the maximal runs of which others fail
        access = matches(t, ACCESS.replace("+", "{16,}"))
        hexes = matches(t, HEX.replace("+", "{24,}"))
        base = F.concat(F.transform(assign, span(0, "assign")), F.transform(access, span(1, "access")), F.transform(hexes, span(2, "hex")))
        random = F.transform(F.filter(matches(t, CANDIDATE), lambda m: looks_random(m["found"])), span(3, "entropy"))
        return let(F.concat(base, random), lambda b: F.when(F.exists(b, lambda x: x["rank"] == 3) & F.exists(b, lambda x: x["rank"] < 3), let(F.array_sort(b), _without_overlaps)).otherwise(F.array_sort(b)))

    return docs.select(*cols, let(body, all_spans).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
