"""Brings the package to Python workers that couldn't import it otherwise."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _within_reach(spark: SparkSession) -> bool:
    """Whether workers find the package by themselves: it is on PYTHONPATH, installed, or in the folder that a local session runs in."""
    if "site-packages" in _ROOT or any(os.path.abspath(p) == _ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return True
    return os.getcwd() == _ROOT and spark.sparkContext.master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files once; the driver serves it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_loamline_shipped", False) or _within_reach(spark):
        return
    folder = tempfile.mkdtemp(prefix="loamline-code-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "loamline"), "zip", _ROOT, "loamline"))
    context._loamline_shipped = True
