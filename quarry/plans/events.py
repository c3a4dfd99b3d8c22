"""Analytics, queue and streaming queries over events, documents and conversations, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import queue as Q
from ..streaming import analytics as S
from .relational import read

Run = Callable[[SparkSession, str], DataFrame]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the analytics log: views are queries, clicks interactions, errors errors, purchases exports, signups
    experiment entries; every query also has its performance. A session is a user's day."""
    (e,) = read(spark, sf_dir, "events")
    return to_log(e)


def to_log(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", F.array(F.lit("query"), F.lit("performance"), F.lit("results"))).when(F.col("event_type").isin("click", "purchase"), F.array(F.lit("interaction"))).when(F.col("event_type") == "error", F.array(F.lit("error"))).otherwise(F.array(F.lit("experiment")))
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    session = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return e.select(
        F.explode(kind).alias("event_type"), "ts", session.alias("session_id"), F.concat(F.lit("q"), (F.col("event_id") % 97).cast("string")).alias("query_id"),
        F.concat(F.lit("query "), (k % 25).cast("string")).alias("query"), F.when(k % 3 == 0, "semantic").when(k % 3 == 1, "keyword").otherwise("phrase").alias("strategy"), F.col("value").alias("search_time"),
        F.named_struct(F.lit("average_score"), k / 100, F.lit("diversity"), F.col("user_id") % 10 / 10, F.lit("coverage"), F.lit(1.0)).alias("quality"),
        F.when(k % 2 == 0, "short_keyword").otherwise("long_phrase").alias("query_type"), k.alias("result_count"),
        F.when(F.col("event_type") == "click", F.when(k % 5 == 0, "refine_query").otherwise("click")).when(F.col("event_type") == "purchase", "export").alias("action"), (F.col("event_id") % 50).cast("string").alias("target_id"), (k % 4 + 1).alias("target_rank"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("dwell_time"), F.lit("exp").alias("experiment_id"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant"), F.create_map(F.lit("value"), F.round("value", 2)).alias("metrics"),
    )


BASE = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id || ':' || strftime(ts, '%Y%m%d') AS session_id, 'q' || (event_id % 97) AS query_id FROM events)"""
PCT = "(SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM ev WHERE event_type = 'view') WHERE rn = least(floor(n * {q}), n - 1) + 1)"


def rounded(f: Callable[[DataFrame], DataFrame], *cols: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(log(spark, sf_dir))
        return out.select(*[F.round(c, 6).alias(c) if c in cols else c for c in out.columns])

    return run


def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each event type's values."""
    (e,) = read(spark, sf_dir, "events")
    return A.index_percentiles(e, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


def result_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .retrieval import result_rows

    out = A.result_quality(result_rows(spark, sf_dir))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("average_score", "score_variance", "diversity", "coverage")])


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir)
    one = lambda df: df.withColumn("one", F.lit(1))
    m = one(A.performance(e)).join(one(A.quality(e)), "one").join(one(A.behavior(e)), "one").drop("one")
    return A.recommendations(m)


def queue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue made of the documents."""
    (d,) = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(s) for s in Q.STATES]), (i % 4 + 1).cast("int"))
    done = i % 4 == 2
    return d.select(
        i.cast("string").alias("id"), F.col("lang").alias("collection_name"), i.cast("string").alias("document_id"), F.col("text").alias("text_content"), (i % 5).cast("int").alias("priority"), status.alias("status"), F.lit(0).alias("retry_count"),
        (i + 1000).alias("created_at"), F.when(done, i + 2000).alias("started_at"), F.when(done, i + 2000 + i % 7).alias("completed_at"), F.when(done, i + 2000 + i % 7).alias("processed_at"), F.lit(None).cast("string").alias("error_message"),
    )


def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.status(queue_table(spark, sf_dir)).withColumn("avg_seconds", F.round("avg_seconds", 6))


def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claim_each(queue_table(spark, sf_dir), 10).select("collection_name", "id", "priority", "created_at")


ST = "count(*) FILTER (m = 0) AS pending, count(*) FILTER (m = 1) AS processing, count(*) FILTER (m = 2) AS completed, count(*) FILTER (m = 3) AS failed, count(*) AS total, round(avg(CASE WHEN m = 2 THEN doc_id % 7 END), 6) AS avg_seconds, min(CASE WHEN m = 0 THEN doc_id + 1000 END) AS oldest_pending"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = read(spark, sf_dir, "events")
    s = F.concat(F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"))
    return d.select("event_id", T.cache_key(s).alias("key"), F.sha1(s).alias("s1"), T.format_bytes(F.col("event_id") * 1000 + 1).alias("bytes"), T.format_duration(F.col("event_id") * 100 + 7).alias("duration"))


def bytes_sql(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN format('{{:.2f}} KB', {n} / 1024) WHEN {n} < 1073741824 THEN format('{{:.2f}} MB', {n} / 1048576) ELSE format('{{:.2f}} GB', {n} / 1073741824) END"


def duration_sql(n: str) -> str:
    return f"CASE WHEN {n} < 1000 THEN {n} || 'ms' WHEN {n} < 60000 THEN format('{{:.1f}}s', {n} / 1000.0) WHEN {n} < 3600000 THEN format('{{:.1f}}m', {n} / 60000.0) ELSE format('{{:.1f}}h', {n} / 3600000.0) END"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and words of each conversation."""
    (c,) = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.size(F.split("text", r"\s+"))).alias("words"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling minute metrics, by a stream over the events file; equal to the batch result."""
    return S.run_once(spark, sf_dir, lambda df: S.tumbling(to_log(df), "1 hour", "1 hour"), "complete")


RECOMMEND_SQL = f"""WITH {BASE}, s AS (SELECT session_id, count(*) FILTER (event_type = 'view') AS n FROM ev GROUP BY 1),
m AS (SELECT avg(value) FILTER (event_type = 'view') AS avg_time, count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN ('view', 'error')), 0) AS error_rate, avg(k / 100) FILTER (event_type = 'view') AS average_score,
 count(*) FILTER (event_type = 'purchase' OR event_type = 'click' AND k % 5 <> 0) / nullif(count(*) FILTER (event_type IN ('click', 'purchase')), 0) AS satisfaction, count(*) FILTER (event_type = 'click' AND k % 5 <> 0) / nullif(count(*) FILTER (event_type = 'view'), 0) AS click_rate,
 (SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) FROM s) AS bounce_rate FROM ev)
{" UNION ALL ".join(f"SELECT '{n}' AS name, '{i}' AS impact FROM m WHERE {c}" for n, c, i in A.RECOMMENDATIONS)}"""
STREAM_SQL = """SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) FILTER (event_type = 'view') AS queries, count(*) FILTER (event_type = 'error') AS errors, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS total_time FROM events GROUP BY 1"""
QUERIES: dict[str, tuple[Run, str | None]] = {
    "an_performance": (
        rounded(A.performance, "avg_time", "error_rate", "success_rate"),
        f"""WITH {BASE}, c AS (SELECT count(*) FILTER (event_type = 'view') AS total_queries, round(avg(value) FILTER (event_type = 'view'), 6) AS avg_time, count(*) FILTER (event_type = 'error') AS errors FROM ev)
SELECT c.*, {PCT.format(q=0.5)} AS p50, {PCT.format(q=0.95)} AS p95, {PCT.format(q=0.99)} AS p99, round(errors / (total_queries + errors), 6) AS error_rate, round(1 - errors / (total_queries + errors), 6) AS success_rate FROM c""",
    ),
    "an_percentiles": (stats_by_type, "SELECT event_type, " + ", ".join(f"max(value) FILTER (rn = least(floor(n * {q}), n - 1) + 1) AS {name}" for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1"),
    "an_strategy": (rounded(A.by_strategy, "avg_time", "avg_quality"), f"WITH {BASE} SELECT CASE k % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' ELSE 'phrase' END AS strategy, count(*) AS uses, round(avg(value), 6) AS avg_time, round(avg(k / 100), 6) AS avg_quality FROM ev WHERE event_type = 'view' GROUP BY 1"),
    "an_quality": (rounded(A.quality, "average_score", "diversity", "coverage", "satisfaction"), f"WITH {BASE} SELECT round(avg(k / 100) FILTER (event_type = 'view'), 6) AS average_score, round(avg(user_id % 10 / 10) FILTER (event_type = 'view'), 6) AS diversity, 1.0::DOUBLE AS coverage, round(avg(CASE WHEN event_type = 'purchase' OR k % 5 <> 0 THEN 1.0 ELSE 0 END) FILTER (event_type IN ('click', 'purchase')), 6) AS satisfaction FROM ev"),
    "an_query_types": (
        rounded(A.by_query_type, "avg_quality", "avg_results"),
        f"WITH {BASE}, v AS (SELECT * FROM ev WHERE event_type = 'view'), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts) AS n FROM v) WHERE n = 1) SELECT CASE WHEN v.k % 2 = 0 THEN 'short_keyword' ELSE 'long_phrase' END AS query_type, count(*) AS queries, round(avg(f.k / 100), 6) AS avg_quality, round(avg(f.k), 6) AS avg_results FROM v JOIN f USING (query_id) GROUP BY 1",
    ),
    "an_result_quality": (result_quality, "SELECT source AS query_id, round(avg(n_chars / 1000.0), 6) AS average_score, round(var_pop(n_chars / 1000.0), 6) AS score_variance, round(count(DISTINCT substr(split_part(text, chr(10), 1), 1, 50) || substr(text, 1, 100)) / count(*), 6) AS diversity, round(least(1.0, count(*) / 10)::DOUBLE, 6) AS coverage FROM documents GROUP BY 1"),
    "an_behavior": (
        rounded(A.behavior, "queries_per_session", "bounce_rate", "avg_words", "click_rate", "top1_click_rate", "avg_dwell", "refinement_rate", "interaction_rate"),
        f"""WITH {BASE}, s AS (SELECT session_id, count(*) FILTER (event_type = 'view') AS n FROM ev GROUP BY 1), i AS (SELECT *, event_type = 'purchase' AS p, event_type = 'click' AND k % 5 <> 0 AS c FROM ev WHERE event_type IN ('click', 'purchase')), q AS (SELECT count(*) AS n, count(DISTINCT k % 25) AS u FROM ev WHERE event_type = 'view')
SELECT (SELECT count(*) FROM s) AS sessions, (SELECT round(avg(n), 6) FROM s) AS queries_per_session, (SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 6) FROM s) AS bounce_rate, q.n AS queries, q.u AS unique_queries, 2.0::DOUBLE AS avg_words,
 (SELECT round(count(*) FILTER (c) / q.n, 6) FROM i) AS click_rate, (SELECT round(count(*) FILTER (c AND k % 4 = 0) / count(*) FILTER (c), 6) FROM i) AS top1_click_rate, (SELECT round(avg(value) FILTER (NOT p), 6) FROM i) AS avg_dwell,
 (SELECT round(count(*) FILTER (NOT p AND k % 5 = 0) / count(DISTINCT query_id), 6) FROM i) AS refinement_rate, (SELECT round(count(DISTINCT query_id || '|' || (event_id % 50)) / (10 * count(DISTINCT query_id)), 6) FROM i) AS interaction_rate FROM q""",
    ),
    "an_top_queries": (lambda s, d: A.top_queries(log(s, d), 10), f"WITH {BASE} SELECT 'query ' || (k % 25) AS query, count(*) AS uses FROM ev WHERE event_type = 'view' GROUP BY 1 ORDER BY uses DESC, query LIMIT 10"),
    "an_time_series": (rounded(lambda e: A.time_series(e, "query_count", "hour"), "value"), "SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, (count(*) FILTER (event_type = 'view'))::DOUBLE AS value FROM events GROUP BY 1"),
    "an_time_series_mean": (rounded(lambda e: A.time_series(e, "average_response_time", "day"), "value"), "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, round(coalesce(avg(value) FILTER (event_type = 'view'), 0), 6) AS value FROM events GROUP BY 1"),
    "an_interval_metrics": (rounded(lambda e: A.interval_metrics(e, "day"), "avg_time", "error_rate", "errors_per_query", "satisfaction", "satisfaction_per_query"), f"WITH {BASE}, u AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, 'query ' || (k % 25) AS query, count(*) AS uses FROM ev WHERE event_type = 'view' GROUP BY 1, 2), l AS (SELECT bucket, string_agg(query, ',' ORDER BY rn) AS top_queries FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY uses DESC, query) AS rn FROM u) WHERE rn <= 5 GROUP BY 1), b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) FILTER (event_type = 'view') AS queries, count(DISTINCT session_id) AS sessions, round(coalesce(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type = 'view'), 0), 0), 6) AS errors_per_query, round(coalesce(count(*) FILTER (event_type = 'purchase' OR event_type = 'click' AND k % 5 <> 0) / nullif(count(*) FILTER (event_type = 'view'), 0), 0), 6) AS satisfaction_per_query, round(avg(value) FILTER (event_type = 'view'), 6) AS avg_time, round(coalesce(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN ('view', 'error')), 0), 0), 6) AS error_rate, round(coalesce(avg(CASE WHEN event_type = 'purchase' OR k % 5 <> 0 THEN 1.0 ELSE 0 END) FILTER (event_type IN ('click', 'purchase')), 0), 6) AS satisfaction FROM ev GROUP BY 1) SELECT b.*, coalesce(top_queries, '') AS top_queries FROM b LEFT JOIN l USING (bucket)"),
    "an_top_queries_daily": (lambda s, d: A.top_queries(log(s, d), 3, "day"), f"WITH {BASE}, u AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, 'query ' || (k % 25) AS query, count(*) AS uses FROM ev WHERE event_type = 'view' GROUP BY 1, 2) SELECT bucket, query, uses, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY uses DESC, query) AS rn FROM u) WHERE rn <= 3"),
    "an_experiment": (rounded(A.experiments, "total"), f"WITH {BASE} SELECT 'exp' AS experiment_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, 'value' AS metric, round(sum(round(value, 2)), 6) AS total, count(DISTINCT session_id) AS participants FROM ev WHERE event_type = 'signup' GROUP BY ALL"),
    "an_smoothed": (rounded(A.smoothed, "smoothed"), f"WITH {BASE}, x AS (SELECT CASE k % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' ELSE 'phrase' END AS strategy, value, row_number() OVER (PARTITION BY k % 3 ORDER BY ts DESC, query_id DESC) - 1 AS after FROM ev WHERE event_type = 'view') SELECT strategy, 'short' AS size, round(sum(0.1 * pow(0.9, after) * value), 6) AS smoothed FROM x GROUP BY 1"),
    "an_latency": (rounded(lambda e: A.latency_stats(e.where("event_type = 'performance'")), "mean", "stddev"), f"WITH {BASE} SELECT min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, {PCT.format(q=0.5)} AS median, {PCT.format(q=0.95)} AS p95, {PCT.format(q=0.99)} AS p99 FROM ev WHERE event_type = 'view'"),
    "an_recommendations": (recommend, RECOMMEND_SQL),
    "an_sessions": (sessions, "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, CAST(sum(len(string_split_regex(text, '\\s+'))) AS BIGINT) AS words FROM conversations GROUP BY 1"),
    "queue_status": (queue_status, f"WITH d AS (SELECT *, doc_id % 4 AS m FROM documents) SELECT lang AS collection_name, {ST} FROM d GROUP BY 1 UNION ALL SELECT '*', {ST} FROM d"),
    "queue_claim": (queue_claim, "SELECT collection_name, id, priority, created_at FROM (SELECT lang AS collection_name, CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 5 AS INTEGER) AS priority, doc_id + 1000 AS created_at, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 5 DESC, doc_id, CAST(doc_id AS VARCHAR)) AS n FROM documents WHERE doc_id % 4 = 0) WHERE n <= 10"),
    "fn_hash_format": (hashes, f"""SELECT event_id, sha256('{{"p0":"' || event_type || '/' || user_id || '"}}') AS key, sha1(event_type || '/' || user_id) AS s1, {bytes_sql('(event_id * 1000 + 1)')} AS bytes, {duration_sql('(event_id * 100 + 7)')} AS duration FROM events"""),
    "stream_tumbling": (streamed, STREAM_SQL),
}
