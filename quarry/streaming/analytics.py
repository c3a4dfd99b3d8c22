"""Search analytics over a stream of events.

Late events count until the watermark (10 minutes by default) has passed their window; the reference semantics
have no late data, so this is this engine's own rule. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..workspace import fresh_path

WATERMARK = "10 minutes"


def read_events(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def tumbling(log: DataFrame, window: str = "1 minute", late: str = WATERMARK) -> DataFrame:
    """bucket, queries, errors, total_time."""
    b = log.withWatermark("ts", late).groupBy(F.window("ts", window))
    q = F.col("event_type") == "query"
    return b.agg(F.count_if(q).alias("queries"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "performance", F.col("search_time"))), F.lit(0.0)), 4).alias("total_time")).select(F.col("window.start").alias("bucket"), "queries", "errors", "total_time")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = WATERMARK) -> DataFrame:
    """Gap-based sessions of each session_id (an addition to explicit ids): start, end, events, queries."""
    s = log.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "query").alias("queries")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "queries")


def session_state(log: DataFrame, idle_ms: int = 1_800_000) -> DataFrame:
    """Running state of each session by explicit id, dropped after idle_ms of event time: session_id, queries,
    interactions, errors, first_ts, last_ts (ms)."""
    out = "session_id string, queries long, interactions long, errors long, first_ts long, last_ts long"
    state = "queries long, interactions long, errors long, first_ts long, last_ts long"

    def update(key: tuple, batches: Iterator[pd.DataFrame], st: Any) -> Iterator[pd.DataFrame]:
        if st.hasTimedOut:
            st.remove()
            return
        q, i, e, first, last = st.get if st.exists else (0, 0, 0, None, None)
        for b in batches:
            counts = b["event_type"].value_counts()
            q, i, e = q + int(counts.get("query", 0)), i + int(counts.get("interaction", 0)), e + int(counts.get("error", 0))
            low, high = int(b["ms"].min()), int(b["ms"].max())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        st.update((q, i, e, first, last))
        at = max(last + idle_ms, st.getCurrentWatermarkMs() + 1)
        st.setTimeoutTimestamp(at)
        yield pd.DataFrame({"session_id": [key[0]], "queries": [q], "interactions": [i], "errors": [e], "first_ts": [first], "last_ts": [last]})

    rows = log.withWatermark("ts", WATERMARK).select("session_id", "event_type", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("session_id").applyInPandasWithState(update, out, state, "update", "EventTimeTimeout")


def experiments(log: DataFrame) -> DataFrame:
    """Running totals per experiment, variant and metric; participants() counts the sessions."""
    x = log.where("event_type = 'experiment'").select("experiment_id", "variant", F.explode("metrics").alias("metric", "v"))
    return x.groupBy("experiment_id", "variant", "metric").agg(F.sum("v").alias("total"))


def participants(log: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Exact numbers of sessions by experiment and variant: a session counts when it first appears. Its state is a row
    for each session, kept by key over all tasks."""
    x = log.where("event_type = 'experiment'").withWatermark("ts", late).dropDuplicates(["experiment_id", "variant", "session_id"])
    return x.groupBy("experiment_id", "variant").agg(F.count("session_id").alias("participants"))


def profiles(log: DataFrame) -> DataFrame:
    """Running word preferences of each session: 0.1 a use of a word of more than three letters, at most 1."""
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 3)
    each = log.where("event_type = 'query'").select("session_id", F.explode(words).alias("preference"))
    return each.groupBy("session_id", "preference").agg(F.least(F.lit(1.0), F.round(0.1 * F.count(F.lit(1)), 10)).alias("weight"))


def alerts(log: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    """Slow queries and errors as they come."""
    slow = (F.col("event_type") == "performance") & (F.col("search_time") > slow_ms)
    return log.where(slow | (F.col("event_type") == "error")).select("ts", "session_id", "query_id", F.when(slow, "slow_query").otherwise("error").alias("alert"), "search_time")


def retained(log: DataFrame, days: int = 30) -> DataFrame:
    """What is younger than days, by the wall clock."""
    return log.where(F.col("ts") > F.current_timestamp() - F.make_dt_interval(F.lit(days)))


def listen(log: DataFrame, listeners: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch goes to the listeners of its event types; "all" gets everything."""

    def batch(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            for kind, f in listeners.items():
                f(df if kind == "all" else df.where(F.col("event_type") == kind), n)
        finally:
            df.unpersist()

    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def process_queue(items: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Embedding queue as a stream: pending items of each micro-batch go to handle, in order of priority."""

    def batch(df: DataFrame, n: int) -> None:
        pending = df.where("status = 'pending'").orderBy(F.desc("priority"), "created_at")
        handle(pending)

    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()


def run_once(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame], mode: str = "append", table: str = "events") -> DataFrame:
    """f over a stream of a table's file, run to its end; the result as a batch DataFrame."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # a file source wants a folder; a pattern serves for a file and for a folder of parts alike
    name = fresh_path(spark, "stream")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = source.parquet(path if _is_folder(spark, path) else f"{sf_dir}/{table}.parque[t]")
    # batches go to Parquet, not to the driver: in complete mode the last is the result, else all together
    out = f(stream)
    done: list[int] = []

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{name}/batch={n}")
        done.append(n)

    q = out.writeStream.foreachBatch(write).option("checkpointLocation", f"{name}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], out.schema)
    chosen = done[-1:] if mode == "complete" else done
    return spark.read.schema(out.schema).parquet(*[f"{name}/batch={n}" for n in chosen]).select(*out.columns)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
