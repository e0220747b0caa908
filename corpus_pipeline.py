"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing and encoding, one stage after the other.

Each stage gets the rows that the one before kept; ``run`` writes what a stage returns to the shared folder
and reads it again, so a lost executor costs no more than a stage, and deletes what a stage is through with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.common import stages_run, table
from loamline.llm.exact_dedup import drop_copies
from loamline.llm.mixing import mixed
from loamline.llm.near_balls import drop_near
from loamline.llm.pieces import encode_pieces
from loamline.llm.quality import drop_poor, fit_quality
from loamline.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no learned rule rejects; the rules are learned from the labels of these documents."""
    return drop_poor(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are 0.8 alike or more, the one with the smallest id."""
    return drop_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids: doc_id, lang, source, ids and n_ids."""
    keep = [F.col(c) for c in ("doc_id", "lang", "source")]
    return encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), keep=keep).withColumn("n_ids", F.size("ids").cast("bigint"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("pieces", encode)]

#: No stage order of this kind can be put in SQL (learned rules, SimHash balls, pieces); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages_run(spark, table(spark, sf_dir, "documents"), STAGES, sf_dir)
