"""The embedding queue: a table of work items and the transitions of their states, set at a time.

Items: id, collection_name, document_id, text_content, priority, status (pending, processing, completed,
failed), retry_count, created_at, started_at, completed_at, processed_at (unix seconds), error_message.
Each operation takes the table and gives the next one; callers write it (sources.store does).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EmbeddingProvider, embed
from ..workspace import fresh_path

SCHEMA = """id string, collection_name string, document_id string, text_content string, priority int, status string, retry_count int,
 created_at long, started_at long, completed_at long, processed_at long, error_message string"""
STATES = ("pending", "processing", "completed", "failed")


def enqueue(queue: DataFrame, items: DataFrame, now: int, collections: DataFrame | None = None, dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """(queue with items (collection_name, document_id, text_content, priority), rejected items of unknown
    collections). dedupe leaves out items whose document is already pending."""
    rejected = items.limit(0)
    if collections is not None:
        names = collections.select(F.col("name").alias("collection_name"))
        rejected = items.join(names, "collection_name", "left_anti")
        items = items.join(names, "collection_name", "left_semi")
    if dedupe:
        waiting = queue.where("status = 'pending'").select("collection_name", "document_id")
        items = items.join(waiting, ["collection_name", "document_id"], "left_anti").dropDuplicates(["collection_name", "document_id"])
    priority = F.coalesce("priority", F.lit(0)) if "priority" in items.columns else F.lit(0)
    new = items.select(
        F.sha2(F.concat_ws("\0", "collection_name", "document_id", F.lit(str(now)), F.coalesce("text_content", F.lit(""))), 256).alias("id"), "collection_name", "document_id", "text_content",
        priority.cast("int").alias("priority"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(now).cast("long").alias("created_at"),
        *[F.lit(None).cast("long").alias(c) for c in ("started_at", "completed_at", "processed_at")], F.lit(None).cast("string").alias("error_message"),
    )
    return queue.unionByName(new), rejected


def claim(queue: DataFrame, batch: int = 10, collection: str | None = None) -> DataFrame:
    """The next pending items: highest priority first, then oldest."""
    pending = queue.where("status = 'pending'")
    if collection is not None:
        pending = pending.where(F.col("collection_name") == collection)
    return pending.orderBy(F.desc("priority"), "created_at", "id").limit(batch)


def claim_each(queue: DataFrame, batch: int = 10) -> DataFrame:
    """The next items of every collection at once."""
    w = Window.partitionBy("collection_name").orderBy(F.desc("priority"), "created_at", "id")
    return queue.where("status = 'pending'").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= batch).drop("__n")


@dataclass
class Processed:
    queue: DataFrame
    vectors: DataFrame
    processed: int
    failed: int
    remaining: int


def process(queue: DataFrame, docs: DataFrame, provider: EmbeddingProvider, now: int, batch: int = 10, max_retries: int = 3, collection: str | None = None) -> Processed:
    """Claim a batch, embed it, and settle each item: completed with a vector (rowid, embedding), or back to pending
    until its retries are used up, then failed. An item whose document is gone fails like any other."""
    taken = claim(queue, batch, collection)
    made = embed(taken.select("id", "collection_name", "document_id", "text_content"), provider, "text_content")
    places = docs.select(F.col("collection").alias("collection_name"), F.col("id").alias("document_id"), "rowid")
    done = made.join(places, ["collection_name", "document_id"], "left").select(
        "id", "rowid", "embedding", F.when(F.col("rowid").isNull(), "document not found").when(F.col("embedding").isNull(), "embedding failed").alias("why")
    )
    path = fresh_path(queue.sparkSession, "embedded")  # written once: the provider isn't asked again
    done.write.parquet(path)
    done = queue.sparkSession.read.schema(done.schema).parquet(path)
    ok = F.col("why").isNull()
    rows = queue.join(F.broadcast(done.select("id", "why", F.lit(True).alias("taken"))), "id", "left")  # at most batch rows
    taken_ = F.coalesce("taken", F.lit(False))
    tries = F.col("retry_count") + 1
    status = F.when(~taken_, F.col("status")).when(ok, "completed").when(tries < max_retries, "pending").otherwise("failed")
    when = lambda c, x, old: F.when(taken_ & c, F.lit(now).cast("long")).otherwise(F.col(old)).alias(x)
    after = rows.select(
        "id", "collection_name", "document_id", "text_content", "priority", status.alias("status"), F.when(taken_ & ~ok, tries).otherwise(F.col("retry_count")).alias("retry_count"), "created_at",
        when(F.lit(True), "started_at", "started_at"), when(ok, "completed_at", "completed_at"), when(F.lit(True), "processed_at", "processed_at"),
        F.when(taken_, F.col("why")).otherwise(F.col("error_message")).alias("error_message"),
    )
    vectors = done.where(ok).select("rowid", "embedding")
    counts = done.agg(F.count(F.lit(1)).alias("n")).first().n
    states = after.agg(F.count_if((F.col("status") == "failed") & (F.col("processed_at") == now)).alias("f"), F.count_if((F.col("status") == "pending") if collection is None else (F.col("status") == "pending") & (F.col("collection_name") == collection)).alias("p")).first()
    return Processed(after, vectors, counts, states.f, states.p)


def status(queue: DataFrame) -> DataFrame:
    """Per collection and for all (collection "*"): items by state, total, mean seconds of completed ones, oldest
    pending."""
    one = queue.groupBy("collection_name").agg(*_measures())
    every = queue.agg(*_measures()).withColumn("collection_name", F.lit("*"))
    return one.unionByName(every)


def _measures() -> list:
    seconds = F.when(F.col("status") == "completed", F.col("processed_at") - F.col("started_at"))
    return [*[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.count(F.lit(1)).alias("total"), F.avg(seconds).alias("avg_seconds"), F.min(F.when(F.col("status") == "pending", F.col("created_at"))).alias("oldest_pending")]


def clear(queue: DataFrame, collection: str | None = None, state: str | None = None, older_than: int | None = None) -> tuple[DataFrame, int]:
    """(queue without the matching items, how many went)."""
    hit = F.lit(True)
    if collection is not None:
        hit = hit & (F.col("collection_name") == collection)
    if state is not None:
        hit = hit & (F.col("status") == state)
    if older_than is not None:
        hit = hit & (F.col("created_at") < older_than)
    return queue.where(~hit), queue.where(hit).count()
