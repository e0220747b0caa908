"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, one_of_each, row_key, staged, with_keys

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def placed(rows: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, Column]:
    """``rows`` (stored) in a range order over many tasks with ``place``, and the task's number as an expression.

    Places ascend within a task; ranks follow with the counts of the tasks before, which are few rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), label)
    return out, F.shiftright("place", 33)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(source, source_size, docs, target, share, offset), one row per source, from (source, size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a
    target stops at ``cap`` times its source's size and the excess goes to the others by weight, again and again
    until none is above.  Sources are aggregated in many tasks; a round of sharing is one sum over them.
    """
    per = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    per, part = placed(per, [F.col("source").asc_nulls_last()], "source-order")
    # one row per task
    runs = per.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("place").alias("first")).orderBy("part").collect()
    shifts, before = {}, 0
    for r in runs:
        shifts[r["part"]], before = before - r["first"], before + r["rows"]
    shift = F.create_map(*[F.lit(x).cast("bigint") for kv in shifts.items() for x in kv])[part] if shifts else F.lit(0)
    per = per.withColumn("k", F.col("place") + shift).drop("place")
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("k") % len(weights)).cast("int")).cast("double"))
    per = per.withColumn("room", cap * F.col("source_size").cast("double"))
    # sums of whole numbers are exact in any order
    level, full = 0.0, None
    while True:
        above = F.col("room") < level * F.col("weight")
        row = per.agg(F.sum("source_size"), F.sum(F.when(above, F.col("room"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if row[2] is None or row[3] == full:
            break
        full, level = row[3], (float(row[0]) - (row[1] or 0.0)) / row[2]
    per = per.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("room")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a fixed pseudo-random offset in [0, 1), a multiple of 1/65536 so that sums with whole numbers are exact
    offset = ((F.col("k") * 40503 + F.lit(seed) * 30011) % 65536) / 65536
    return per.select("source", "source_size", "docs", "target", share.alias("share"), offset.alias("offset"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", keys: list[Column] | None = None, **options) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source, source_size, target, copies, taken.

    Documents of a source are put in an order that climbs over every other size and comes down over the
    rest; each expects target / source_size copies, the expected copies are summed up along that order,
    one offset per source is added, and a document is taken once for each whole number that the sum passes
    on it.  As neighbours have like sizes and the ends meet, the words taken come near the target.  A document is
    taken at most three times.  The order is made by a range sort, which splits a source of any size over
    many tasks; ranks come from row numbers within the sorted partitions and sums over partitions.

    Null texts have size 0, null sources form one source, null ids come first, repeated rows count each.
    An empty table gives an empty result; ``keys`` are carried along.
    """
    keys = keys or []
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first()]
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *keys)
    # texts are read once: a range sort would run what comes before it twice
    ranked, part = placed(staged(sizes, "sizes"), order, "mix-order")
    runs = ranked.groupBy(part.alias("part"), "source").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per partition and one per source
    runs = runs.withColumn("shift", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first"))
    targets = source_targets(ranked, **options)
    runs = runs.join(targets, runs["source"].eqNullSafe(targets["source"])).select(
        runs["part"], runs["source"].alias("s"), "shift", "source_size", "docs", "target", "share", "offset"
    )
    rank = F.col("place") + F.col("shift")
    # up by every other rank and down by the rest: the order begins and ends with small documents
    spot = F.when(rank % 2 == 0, F.expr("(place + shift) div 2")).otherwise(F.expr("docs - 1 - (place + shift) div 2"))
    passed = lambda k: F.floor(k * F.col("share") + F.col("offset"))
    return (
        ranked.join(runs, (part == F.col("part")) & ranked["source"].eqNullSafe(F.col("s")))
        .withColumn("copies", (passed(spot + 1) - passed(spot)).cast("bigint"))
        .select(*ranked.columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
        .drop("place")
    )


def mixed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    key_id, key_sha = row_key(text, id_col)
    plan = mix(docs, text, id_col, source, [key_sha], **options).withColumnRenamed("doc_id", "_k_id").withColumnRenamed("source", "_k_source")
    names = ["_k_id", "_k_sha", "_k_source"]
    # rows that agree in all three: their copies are summed, and one of them is repeated
    copies = plan.groupBy(*names).agg(F.sum("copies").alias("_copies")).filter(F.col("_copies") > 0)
    left = with_keys(docs, {"_l_id": key_id, "_l_sha": key_sha, "_l_source": F.col(source)})
    joined = left.join(copies, [F.col(f"_l{c[2:]}").eqNullSafe(copies[c]) for c in names])
    one = one_of_each(joined, ["_l_id", "_l_sha", "_l_source"], text, F.max("_copies").alias("_copies"))
    return one.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")).select("_row.*")
