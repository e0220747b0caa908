"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``; optimizer rules can't copy it into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op) -> Column:
    """``op`` of every entry of an array of numbers and all before it, for sums or maxima.

    The array is folded in pieces of about the square root of its size, so that no long array is copied for
    every entry.
    """
    kind = "array<bigint>"

    def fold(v: Column, end) -> Column:
        last = lambda a: F.get(a, F.size(a) - 1)
        return F.aggregate(v, F.array().cast(kind), lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, op(last(a), end(x))).otherwise(end(x)).cast("bigint"))).cast(kind))

    def pieces(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda k: fold(F.slice(v, k * step + 1, step), lambda x: x))

    def put_together(p: Column) -> Column:
        ends = fold(p, lambda piece: F.get(piece, F.size(piece) - 1))
        return let(ends, lambda e: F.flatten(F.transform(p, lambda piece, k: F.when(k == 0, piece).otherwise(F.transform(piece, lambda x: op(F.get(e, k - 1), x))))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(pieces(v), put_together)).otherwise(F.array().cast(kind)))


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine (tests) a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        app = spark.sparkContext.applicationId
        found = _local_dirs.get(app) or "file://" + tempfile.mkdtemp(prefix="loamline-")
        _local_dirs[app] = found
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_made: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    at = new_folder(spark, label)
    df.write.parquet(at)
    _made.append(at)
    return spark.read.schema(df.schema).parquet(at)


def stages_run(spark: SparkSession, docs: DataFrame, stages: list[tuple], sf_dir: str) -> DataFrame:
    """The stages one after the other, each stored; what a stage stored on its way, and its input, go once its result is there."""
    result = None
    for name, stage in stages:
        before = len(_made)
        docs = staged(stage(spark, docs, sf_dir), name)
        spent, _made[before:] = _made[before:-1], _made[-1:]
        if result is not None:
            _made.remove(result)
            spent.append(result)
        result = _made[-1]
        for at in spent:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that hold at least this many rows, and this share of all rows, are joined apart from the others.
FREQUENT_ROWS, MOST_FREQUENT = 4096, 10_000


def join_frequent(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key, where a few keys may hold most rows of ``left``.

    ``counts`` (stored) holds the keys and ``rows``, how many rows of ``left`` each has.  At most MOST_FREQUENT
    keys can have that share of all rows, so theirs of ``right`` are broadcast; the rest is shuffled.
    """
    total = counts.filter(F.col("rows") >= FREQUENT_ROWS).agg(F.sum("rows")).first()[0]
    if total is None:
        return left.join(right, on)
    few = counts.filter(F.col("rows") >= max(FREQUENT_ROWS, total // MOST_FREQUENT)).select(*on)
    hot = F.broadcast(staged(right.join(F.broadcast(few), on, "left_semi"), "frequent"))
    return left.join(hot, on).unionByName(left.join(F.broadcast(few), on, "left_anti").join(right, on))


def row_key(text: str = "text", id_col: str = "doc_id") -> list[Column]:
    """Columns by which a row of documents is found again: rows equal in both are interchangeable."""
    return [F.col(id_col).alias("_k_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_k_sha")]


def with_keys(docs: DataFrame, key_cols: dict[str, Column]) -> DataFrame:
    """_row (all columns of ``docs``, whatever their names) and its keys."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(n) for n, c in key_cols.items()])


def one_of_each(rows: DataFrame, key_names: list[str], text: str = "text", *more: Column) -> DataFrame:
    """Of rows with equal keys the least in the other columns: (_row, more...)."""
    kind = rows.schema["_row"].dataType
    order = [F.col(f"_row.`{f.name}`") for f in kind.fields if f.name != text and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return rows.groupBy(*key_names).agg(F.min_by("_row", F.struct(*order, F.lit(0))).alias("_row"), *more)


def semi_by_key(docs: DataFrame, keys: DataFrame, key_cols: dict[str, Column], text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is in ``keys`` (columns named as in ``key_cols``); of rows with equal keys, the least one."""
    names = list(key_cols)
    left = with_keys(docs, {f"_l{c}": v for c, v in key_cols.items()})
    found = left.join(keys, [F.col(f"_l{c}").eqNullSafe(keys[c]) for c in names], "left_semi")
    return one_of_each(found, [f"_l{c}" for c in names], text).select("_row.*")
