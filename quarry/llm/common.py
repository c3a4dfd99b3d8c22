"""Helpers shared by the training-data operators: text normalisation, the shared
folder, and tables that cut lineage."""

from __future__ import annotations

import os
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import fresh_path

#: Runs of anything but space and the ASCII controls tab to carriage return.
TOKEN = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or script."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def n_tokens(c: Column) -> Column:
    """Number of whitespace-delimited tokens of a non-null string."""
    return F.regexp_count(c, F.lit(TOKEN)).cast("long")


#: Spark's setting by which an execution's shuffle files go when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, a lost executor costs
    no earlier stage, and the shuffle files behind it are removed as soon as it is written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such column, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def local_path(path: str) -> str | None:
    """The mounted path of a file: URI, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def write_bytes(path: str, data: bytes) -> None:
    """Write a whole file so that readers see all of it or nothing; a second attempt of
    the same task replaces the first one's file with the same bytes."""
    if (p := local_path(path)) is not None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        tmp = f"{p}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, p)
        return
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    tmp = f"{p}.{uuid.uuid4().hex}.tmp"
    system.create_dir(os.path.dirname(p), recursive=True)
    with system.open_output_stream(tmp) as f:
        f.write(data)
    system.move(tmp, p)


def read_bytes(path: str) -> bytes:
    if (p := local_path(path)) is not None:
        with open(p, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    with system.open_input_file(p) as f:
        return f.read()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
