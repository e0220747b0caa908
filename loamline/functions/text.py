"""Text expressions: identifier-aware words, hashing, token estimates, paths.  All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAKS = r"[^\p{L}\p{Nd}]+|(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def identifier_words(text: Column) -> Column:
    """Lower-case words; camelCase, acronyms and snake_case are taken apart."""
    return F.filter(F.transform(F.split(text, WORD_BREAKS), F.lower), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def fnv1a32(word: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes of a word, as bigint."""
    digits = F.hex(F.encode(word, "UTF-8"))
    byte = lambda i: F.conv(F.substr(digits, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(4294967295))
    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1)))
    return F.when(F.octet_length(word) == 0, F.lit(2166136261)).otherwise(F.aggregate(steps, F.lit(2166136261).cast("bigint"), step))


def estimate_tokens(text: Column) -> Column:
    """About how many model tokens a text has: a quarter of each word's letters, rounded up, and one for any other sign."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    of_words = F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.ceil(F.length(w) / 4))
    return of_words + F.length(F.regexp_replace(text, "[A-Za-z0-9_ \\t\\n\\r]", ""))


def short_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(name, r"\."), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_blank(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*$")


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal and a unit up to T."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for power, unit in enumerate("KMG", 1):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f{unit}", F.bround(n / F.lit(float(1024**power)), 1)))
    return out.otherwise(F.format_string("%.1fT", F.bround(n / F.lit(float(1024**4)), 1)))
