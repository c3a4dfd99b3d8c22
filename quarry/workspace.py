"""The folder that all executors share, for tables that outlive a job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of our own on a local master. A cluster's
    executors could not see that, so there the setting is asked for."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quarry-shared-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; each call has its own, so reruns never mix."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
