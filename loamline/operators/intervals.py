"""Operators on half-open spans (path, start, stop, name) within paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def remove_inside(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans that no region of their path contains.

    A span lies in a region if the furthest stop among regions that start no later reaches its own stop, so
    a running maximum per path does, and no pairs are made.
    """
    row = spans.select(F.struct(*spans.columns)).schema[0].dataType
    both = spans.select("path", "start", "stop", F.lit(1).alias("_kind"), F.struct(*spans.columns).alias("_row")).unionByName(
        regions.select("path", "start", "stop", F.lit(0).alias("_kind"), F.lit(None).cast(row).alias("_row"))
    )
    reach = F.max(F.when(F.col("_kind") == 0, F.col("stop"))).over(Window.partitionBy("path").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    marked = both.withColumn("_reach", reach)
    return marked.filter((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_reach") < F.col("stop")))).select("_row.*")


def unique_spans(spans: DataFrame, sequence: str = "seq") -> DataFrame:
    """One row per (path, start, stop): the first named one in ``sequence``, else the first."""
    order = Window.partitionBy("path", "start", "stop").orderBy(F.col("name") == "", sequence)
    return spans.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def outermost(spans: DataFrame) -> DataFrame:
    """Spans that don't end within one before them, in the order of start and falling stop."""
    before = Window.partitionBy("path").orderBy("start", F.col("stop").desc(), "name").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("stop").over(before)
    return spans.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("stop") > F.col("_reach"))).drop("_reach")


def gaps(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, start, stop) of what the spans leave uncovered of (path, size)."""
    marks = spans.select("path", "start", "stop").unionByName(sizes.select("path", F.col("size").alias("start"), F.col("size").alias("stop")))
    before = Window.partitionBy("path").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    at = marks.withColumn("_from", F.coalesce(F.max("stop").over(before), F.lit(0)))
    return at.filter(F.col("_from") < F.col("start")).select("path", F.col("_from").alias("start"), F.col("start").alias("stop"))


def _enclosing(spans: DataFrame, scopes: DataFrame) -> DataFrame:
    """Every row of ``spans`` as _row, repeated ones too, with the named scopes around it as sorted array _up of (start, -stop, name).

    Spans and scopes of a path are swept by start with a stack, so time grows with what is found and not with
    the pairs of a path.  The rows of a path come sorted and are streamed, a stack at a time.
    """
    row = spans.select(F.struct(*spans.columns).alias("_row")).schema["_row"].dataType
    # scopes before spans that begin with them, outer scopes first
    both = scopes.filter(F.col("name") != "").select("path", "start", "stop", "name", F.lit(0).alias("_kind"), F.lit(None).cast(row).alias("_row")).unionByName(
        spans.select("path", "start", "stop", F.lit("").alias("name"), F.lit(1).alias("_kind"), F.struct(*spans.columns).alias("_row"))
    )
    placed = both.repartition("path").sortWithinPartitions("path", "start", "_kind", F.col("stop").desc(), "name")
    scope = T.StructType([T.StructField("a", T.LongType()), T.StructField("nb", T.LongType()), T.StructField("name", T.StringType())])
    kind = T.StructType([*placed.select("_row").schema.fields, T.StructField("_up", T.ArrayType(scope))])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stack = None, []
        for b in batches:
            up, take = [], []
            for k, (p, start, stop, name, span) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                if p != path:
                    path, stack = p, []
                # what ended before this start can't hold anything that follows
                stack = [s for s in stack if s[1] >= start] if stack and min(s[1] for s in stack) < start else stack
                if span == 0:
                    stack.append((start, stop, name))
                else:
                    take.append(k)
                    up.append([{"a": a, "nb": -z, "name": n} for a, z, n in sorted((s for s in stack if s[1] >= stop), key=lambda s: (s[0], -s[1], s[2]))])
            if take:
                yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(take)), pa.array(up, pa.list_(pa.struct([("a", pa.int64()), ("nb", pa.int64()), ("name", pa.string())])))], names=["_row", "_up"])

    return placed.select("path", F.col("start").cast("bigint"), F.col("stop").cast("bigint"), "name", "_kind", "_row").mapInArrow(sweep, kind)


def qualify(spans: DataFrame, scopes: DataFrame) -> DataFrame:
    """Spans with ``qualified``: the names of the scopes around them, outermost first, and their own."""
    names = F.transform("_up", lambda s: s["name"])
    return _enclosing(spans, scopes).select("_row.*", F.array_join(F.filter(F.concat(names, F.array("_row.name")), lambda x: x != ""), ".").alias("qualified"))


def innermost_scope(spans: DataFrame, scopes: DataFrame) -> DataFrame:
    """Spans with ``scope``: the name of the smallest scope around them, of equal ones the first."""
    size = lambda s: F.struct((-s["nb"] - s["a"]).alias("size"), s["a"].alias("a"), s["name"].alias("name"))
    return _enclosing(spans, scopes).select("_row.*", F.coalesce(F.array_min(F.transform("_up", size))["name"], F.lit("")).alias("scope"))
