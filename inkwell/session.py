"""Shipping this package's code to the Python workers of a session's executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ZIP: list[str] = []
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package; once per application.

    Only code travels this way (Spark's file server hands the archive to every executor, also to
    those that start later); data never does.
    """
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    if not _ZIP:
        here = Path(__file__).resolve().parent
        stem = os.path.join(tempfile.mkdtemp(prefix="code-"), "inkwell_code")
        _ZIP.append(shutil.make_archive(stem, "zip", root_dir=here.parent, base_dir=here.name))
    spark.sparkContext.addPyFile(_ZIP[0])
    _DONE.add(app)
