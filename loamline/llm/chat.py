"""Chat formatting with Spark expressions only.

A conversation becomes one text of blocks ``<s>role[INST]text[/INST]...</s>``: turns are sorted, adjacent
turns of one role are merged into one block that still holds each text by itself, and everything is
concatenated.  The control strings cannot occur in a formatted role or text: ``\\`` is written ``\\e``, and
the first sign of a control string inside a text is written ``\\l`` or ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

BLOCK, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_ESCAPES = [("\\", "\\e"), (BLOCK, "\\ls>"), (END, "\\l/s>"), (OPEN, "\\bINST]"), (CLOSE, "\\b/INST]")]


def escape(text: Column) -> Column:
    for plain, coded in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for coded, plain in (("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation, with the loss mask as array of (start, length).

    The spans count code points of ``formatted`` and hold exactly the escaped texts of the role ``learn``.
    Null roles and texts count as empty; null turns come first; turns with equal numbers are ordered by role
    and text, so repeated rows stay; rows without conv_id form one conversation.  A conversation is one
    value, so its turns have to fit into one row; an empty table gives an empty result.
    """
    none = F.lit("")
    said = F.struct(
        F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), F.coalesce(F.col(role), none).alias("role"), F.coalesce(F.col(text), none).alias("text")
    )
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("said"))
    coded = F.transform("said", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))

    def merged(turns: Column) -> Column:
        """Turns with what is written before and behind their texts: a block opens and closes where the role changes."""
        other = lambda t, i: F.coalesce(F.get(turns, i)["role"] != t["role"], F.lit(True))
        return F.transform(
            turns,
            lambda t, i: F.struct(
                (t["role"] == F.lit(learn)).alias("learnt"),
                F.concat(F.when(other(t, i - 1), F.concat(F.lit(BLOCK), t["role"])).otherwise(F.lit("")), F.lit(OPEN)).alias("before"),
                t["text"].alias("text"),
                F.concat(F.lit(CLOSE), F.when(other(t, i + 1), F.lit(END)).otherwise(F.lit(""))).alias("behind"),
            ),
        )

    def spans(parts: Column) -> Column:
        size = lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["behind"])).cast("bigint")
        ends = running(F.transform(parts, size), lambda a, x: a + x)
        placed = F.zip_with(parts, ends, lambda p, end: F.when(p["learnt"], F.struct((end - F.length(p["behind"]) - F.length(p["text"])).alias("start"), F.length(p["text"]).cast("bigint").alias("length"))))
        return F.filter(placed, lambda s: s.isNotNull())

    # bound once: rows aren't joined with anything, and no array grows step by step
    parts = chats.select("conv_id", let(coded, merged).alias("parts"))
    made = let(F.struct("parts"), lambda x: F.struct(F.array_join(F.transform(x["parts"], lambda p: F.concat(p["before"], p["text"], p["behind"])), "").alias("formatted"), spans(x["parts"]).alias("loss")))
    return parts.select("conv_id", made.alias("made")).select("conv_id", "made.formatted", "made.loss")


#: Signs of a formatted conversation that are cut off at once when spans are read.
PIECE = 4096


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) read back from (conv_id, formatted, loss): the turns as array of (role, text)."""
    blocks = F.filter(F.split("formatted", f"\\Q{END}\\E"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: let(
                unescape(F.substr(F.substring_index(b, OPEN, 1), F.lit(len(BLOCK) + 1))),
                lambda role: F.transform(
                    F.regexp_extract_all(b, F.lit(r"(?s)\[INST\](.*?)\[/INST\]"), F.lit(1)), lambda p: F.struct(role.alias("role"), unescape(p).alias("text"))
                ),
            ),
        )
    )
    # a span is cut from the pieces that it lies in: counting from the beginning for each would be quadratic
    first = lambda s: F.floor(s["start"] / PIECE).cast("int")
    within = lambda cut, s: F.array_join(F.slice(cut, first(s) + 1, F.floor((s["start"] + s["length"]) / PIECE).cast("int") - first(s) + 1), "")
    pieces = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    masked = let(pieces, lambda cut: F.transform("loss", lambda s: unescape(F.substr(within(cut, s), (s["start"] - first(s) * PIECE + 1).cast("int"), s["length"].cast("int")))))
    return formatted.select("conv_id", turns.alias("turns"), masked.alias("loss_texts"))
