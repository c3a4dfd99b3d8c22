"""Makes this package importable by the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="quarry-ship-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    clean = shutil.copytree(here, f"{tmp}/src/quarry", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tmp}/quarry", "zip", os.path.dirname(clean)))
