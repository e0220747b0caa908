"""Files into chunks: paragraphs in SQL, source code by declarations in Python, and chunk ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import is_blank
from .syntax import chunk_source

#: Files whose chunks are handed over at once.
STEP = 200
CHUNK_COLUMNS = "path string, ord bigint, start_line int, end_line int, symbol string, content string, embed_text string"


def paragraphs(files: DataFrame) -> DataFrame:
    """(path, ord, start_line, end_line, content): runs of lines that aren't blank; lines count from one."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    blanks = F.sum(is_blank(F.col("line")).cast("int")).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    islands = lines.withColumn("island", blanks).filter(~is_blank(F.col("line"))).groupBy("path", "island")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    got = islands.agg((F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), joined.alias("content"))
    order = F.row_number().over(Window.partitionBy("path").orderBy("start_line"))
    return got.select("path", (order - 1).cast("bigint").alias("ord"), "start_line", "end_line", "content")


def base_id(path: Column, content: Column) -> Column:
    return F.concat(path, F.lit("#"), F.substring(F.sha2(content, 256), 1, 12))


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with ``id`` made of path and content; the n-th repeat of a content within a file ends in ~n."""
    made = chunks.withColumn("_base", base_id(F.col("path"), F.col("content")))
    again = F.row_number().over(Window.partitionBy("path", "_base").orderBy("ord")) - 1
    return made.withColumn("id", F.when(again == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("~"), again.cast("string")))).drop("_base")


def worth_indexing(content: Column, min_lines: int = 1) -> Column:
    trimmed = F.regexp_replace(content, r"(?U)^\s+|\s+$", "")
    lines = F.length(trimmed) - F.length(F.replace(trimmed, F.lit("\n"), F.lit(""))) + 1
    return content.rlike(r"[_\p{L}\p{Nd}]") & (lines >= min_lines)


def embed_text(path: Column, content: Column, own: Column) -> Column:
    return F.coalesce(own, F.when(F.coalesce(path, F.lit("")) == "", content).otherwise(F.concat(path, F.lit("\n"), content)))


def syntax_chunks(files: DataFrame, settings: Settings = Settings(), provider: str = "syntax") -> DataFrame:
    """Chunks with ids of (path, content) files; ``provider`` is syntax or declarations.

    Each file is one row and is cut within it; files whose syntax can't be read fall back to paragraphs.
    """

    kind = pa.schema([("path", pa.string()), ("ord", pa.int64()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("content", pa.string()), ("embed_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                paths, contents = (c.to_pylist() for c in batch.slice(at, STEP).columns)
                rows = [c for p, t in zip(paths, contents) for c in chunk_source(p, t or "", settings, provider)]
                columns = zip(*rows) if rows else [()] * len(kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return with_ids(files.select("path", "content").mapInArrow(run, CHUNK_COLUMNS))


def line_chunks(files: DataFrame) -> DataFrame:
    return with_ids(paragraphs(files)).withColumn("symbol", F.lit("")).withColumn("embed_text", F.lit(None).cast("string"))


CHUNKERS = {
    "syntax": lambda files, s=Settings(): syntax_chunks(files, s),
    "declarations": lambda files, s=Settings(): syntax_chunks(files, s, "declarations"),
    "line": lambda files, s=Settings(): line_chunks(files),
}


def chunker(name: str = "syntax"):
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name}: one of {', '.join(sorted(CHUNKERS))}")
    return CHUNKERS[name]


def chunker_id(name: str, s: Settings = Settings()) -> str:
    """Name and every setting that isn't the default, so that an index knows how it was made."""
    d, out = Settings(), name
    if name == "syntax":
        for field, mark in (("max_tokens", "+max"), ("overlap", "+ov"), ("min_gap_lines", "+gap")):
            if getattr(s, field) != getattr(d, field):
                out += f"{mark}{getattr(s, field)}"
        out += "+cap" if s.cap_header else ""
    return out
