"""Reciprocal rank fusion and what hybrid search builds on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import DECIMALS


def fuse(lists: DataFrame, k: float, weights: list[float] | None = None, alpha: float = 1.0, n_lists: int | None = None, group: str = "query_id") -> DataFrame:
    """(group, id, score, first) from (group, list_idx, rank, id) rows.

    A row contributes weight / (k + rank); an id's score is its best contribution and ``alpha`` times the
    others.  The best starts at zero; an id that comes twice in a list counts twice.  Weights that aren't as
    many as the lists are all one.  ``first`` is the place where the id comes first and breaks ties.
    """
    use = weights if weights and (n_lists is None or len(weights) == n_lists) else None
    weight = F.coalesce(F.get(F.array(*map(F.lit, use)), F.col("list_idx")), F.lit(1.0)) if use else F.lit(1.0)
    parts = lists.withColumn("part", weight / (k + F.col("rank")))
    best = F.greatest(F.lit(0.0), F.max("part"))
    return parts.groupBy(group, "id").agg((best + alpha * (F.sum("part") - best)).alias("score"), F.min(F.struct("list_idx", "rank")).alias("first"))


def take(fused: DataFrame, top: int, group: str = "query_id") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.round("score", DECIMALS).desc(), "first")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(top, 0))


def collapse(ranked_rows: DataFrame, path: str = "path", group: str = "query_id") -> DataFrame:
    """(group, id, rank): the paths of a ranked list, each where it comes first, ranked without gaps."""
    firsts = ranked_rows.groupBy(group, F.col(path).alias("id")).agg(F.min("rank").alias("at"))
    return firsts.select(group, "id", F.row_number().over(Window.partitionBy(group).orderBy("at")).alias("rank"))


def best_per_path(fused: DataFrame, n: int, group: str = "query_id") -> DataFrame:
    """The ``n`` best rows of each path, with span_rank."""
    order = Window.partitionBy(group, "path").orderBy(F.round("score", DECIMALS).desc(), "first")
    return fused.withColumn("span_rank", F.row_number().over(order)).filter(F.col("span_rank") <= n)
