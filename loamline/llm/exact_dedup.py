"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of characters.  Equal blocks are brought together by a
sort and get one integer name: the pair (row, position) of the first occurrence.  Adjacent names are then
paired and each distinct pair is named in the same way, until every document holds a single name.  Names
come from comparing contents, so two texts share a name only if they are equal; no hash decides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_frequent, let, row_key, semi_by_key, staged

BLOCK_CHARS = 1024
#: Blocks seen at least this often may be salted; at most MAX_HOT of them are, so their list (8 bytes each) can be broadcast.
HOT_LEAST, MAX_HOT, SALTS = 4096, 500_000, 64


def _first_names(blocks: DataFrame, hot_least: int) -> DataFrame:
    """(_row, pos, n, name) and, at pos 0, id and sha: blocks named by their first occurrence.

    One shuffle of the texts.  A block in which a great part of all rows agree is salted over SALTS tasks,
    and the at most MAX_HOT * SALTS local names of salted blocks are then joined into global ones.
    """
    often = staged(blocks.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= hot_least), "hot-blocks")
    total = often.agg(F.sum("c")).first()[0]
    salted = total is not None
    if salted:
        hot = often.filter(F.col("c") >= max(hot_least, total // MAX_HOT)).select("h", F.lit(True).alias("hot"))
        blocks = blocks.join(F.broadcast(hot), "h", "left")
    else:
        blocks = blocks.withColumn("hot", F.lit(None).cast("boolean"))
    me = F.struct("_row", "pos")
    blocks = blocks.withColumn("salt", F.when(F.col("hot"), F.pmod("_row", F.lit(SALTS))).otherwise(F.lit(0)))
    named = blocks.withColumn("name", F.min(me).over(Window.partitionBy("h", "salt", "block")))
    named = named.withColumn("rep", F.when(F.col("hot") & (F.col("name") == me), F.col("block")))
    named = staged(named.select("_row", "pos", "n", "id", "sha", "name", "rep"), "block-names")
    if not salted:
        return named.drop("rep")
    joined = (
        named.filter(F.col("rep").isNotNull())
        .select(F.col("name").alias("local"), F.min("name").over(Window.partitionBy("rep")).alias("global"))
        .filter(F.col("local") != F.col("global"))
    )
    return (
        named.drop("rep")
        .join(joined, F.col("name") == F.col("local"), "left")
        .withColumn("name", F.coalesce("global", "name"))
        .drop("local", "global")
    )


def name_documents(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS, hot_least: int = HOT_LEAST
) -> DataFrame:
    """One row per row of ``docs``: _row, id, sha (of the text), n (its blocks) and name.

    Two rows have equal (n, name) exactly if their texts are equal; null counts as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    cut = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    whole = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), body.alias("_text"))
    whole = whole.select(
        "_row", "id", F.sha2("_text", 256).alias("sha"), let(cut, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(F.lit("")))).alias("b")
    )
    blocks = whole.select("_row", "id", "sha", F.size("b").alias("n"), F.posexplode("b").alias("pos", "block")).select(
        "_row", "pos", "n", "block", F.xxhash64("block").alias("h"), F.when(F.col("pos") == 0, F.col("id")).alias("id"), F.when(F.col("pos") == 0, F.col("sha")).alias("sha")
    )
    named = staged(_first_names(blocks, hot_least), "first-names")
    heads = named.filter(F.col("pos") == 0).select("_row", "id", "sha", "n")
    done = [named.filter(F.col("n") == 1).select("_row", "name")]
    longest = named.agg(F.max("n")).first()[0] or 1
    now = named.filter(F.col("n") > 1).select("_row", "pos", "name", F.col("n").alias("left"))
    none = F.struct(F.lit(-1).cast("bigint").alias("_row"), F.lit(-1).alias("pos"))
    for _ in range(math.ceil(math.log2(longest))):
        odd = F.col("pos") % 2
        pairs = (
            now.groupBy("_row", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("left") / 2).cast("int").alias("left"))
            .agg(F.max(F.when(odd == 0, F.col("name"))).alias("a"), F.max(F.when(odd == 1, F.col("name"))).alias("b"))
            .withColumn("b", F.coalesce("b", none))
        )
        names = staged(pairs.groupBy("a", "b").agg(F.min(F.struct("_row", "pos")).alias("name"), F.count("*").alias("rows")), "pairs")
        now = join_frequent(pairs, names.drop("rows"), ["a", "b"], names).select("_row", "pos", "name", "left")
        now = staged(now, "pair-names")
        done.append(now.filter(F.col("left") == 1).select("_row", "name"))
        now = now.filter(F.col("left") > 1)
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return heads.join(ids, "_row")


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Groups of equal texts; of each group the row with the largest id stays.

    One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.  A null text counts as
    empty, a null id as smaller than any other; of repeated rows with the largest id exactly one has
    ``kept``.  An empty table gives an empty result.  Other columns of ``docs`` are not looked at.
    ``docs`` should be a stored table (its row numbers must come out the same if a task is run again).
    """
    named = staged(name_documents(docs, text, id_col, **options), "document-names")
    best = F.max(F.struct("id", (-F.col("_row")).alias("neg")))
    groups = staged(named.groupBy("n", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    counts = groups.select("n", "name", F.col("group_size").alias("rows"))
    return join_frequent(named, groups, ["n", "name"], counts).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.neg") == -F.col("_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, text, id_col, **options).filter("kept").select(F.col("doc_id").alias("_k_id"), F.col("text_sha256").alias("_k_sha"))
    key_id, key_sha = row_key(text, id_col)
    return semi_by_key(docs, kept, {"_k_id": key_id, "_k_sha": key_sha}, text)
