"""An extension: files as a stream into a stored index.  Ids are made of contents, so a batch may come twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import line_chunks
from ..sources.catalog import Catalog
from ..sources.shared import kept


def follow(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, chunk=line_chunks) -> StreamingQuery:
    """Start a stream over Parquet files of (path, content, version): each batch replaces the chunks of its paths.

    Of several rows of a path in a batch the one of the largest version counts, of equal ones that of the file
    written last; an older version than the stored one changes nothing.
    """
    # a row is as new as the file that it came in; the version goes first if files have one
    stream = spark.readStream.schema("path string, content string, version bigint").parquet(folder)
    stream = stream.select("path", "content", F.coalesce("version", F.lit(0)).alias("version"), F.col("_metadata.file_modification_time").alias("_at"))

    def apply(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct("content", "version"), F.struct("version", "_at", "content")).alias("r")).select("path", "r.*")
        old = catalog.chunks()
        if old is not None:
            newer = old.groupBy("path").agg(F.max("version").alias("have")).filter("have is not null")
            latest = latest.join(newer, "path", "left").filter("have is null or version >= have").drop("have")
        latest = kept(latest, "latest")
        new = chunk(latest).join(latest.select("path", "version"), "path")
        if old is not None:
            new = old.join(latest.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)
        catalog._swap("chunks", new)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and type of an events stream or table; late rows beyond ``delay`` are dropped in streams."""
    out = events.withWatermark("ts", delay) if events.isStreaming else events
    return out.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
