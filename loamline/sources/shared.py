"""Tables written to the folder that all executors share (spark.checkpoint.dir), to be read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine (tests) a temporary folder where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        app = spark.sparkContext.applicationId
        at = _local_folders.get(app) or "file://" + tempfile.mkdtemp(prefix="loamline-")
        _local_folders[app] = at
    return at.rstrip("/")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all shuffle partitions: rows of a small file that each mean much work would else be one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once and read back: later uses don't compute it again, and lost executors don't matter."""
    at = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
