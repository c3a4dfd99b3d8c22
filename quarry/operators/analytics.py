"""Search analytics over an event log.

Events: event_type (query, results, interaction, performance, error, experiment), ts (timestamp), session_id,
query_id, query, strategy, search_time, quality struct<average_score, diversity, coverage>, query_type,
result_count, action, target_id, target_rank, dwell_time, experiment_id, variant, metrics map<string,double>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVALS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day"}


def between(events: DataFrame, start=None, end=None, types: list[str] | None = None) -> DataFrame:
    """Inclusive time range and event types."""
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        events = events.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return events.where(F.col("event_type").isin(types)) if types else events


def retain(events: DataFrame, now, days: int = 30) -> DataFrame:
    return events.where(F.col("ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def index_percentiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles by place: element floor(n * q), from 0, of the ascending values. Places come from counts of
    distinct values, which are combined before the shuffle and cumulated within each group."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    # without groups, ranges of the value are cumulated apart and then offset, so that no task sorts everything
    if by:
        w = Window.partitionBy(*by).orderBy(value)
        run = counts.withColumn("hi", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    else:
        n = df.where(F.col(value).isNotNull()).count()
        edges = [r for r in counts.stat.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.005)] if n else []
        slot = F.lit(0)
        for e in sorted(set(edges)):
            slot = slot + (F.col(value) > F.lit(e)).cast("int")
        parts = counts.withColumn("slot", slot)
        sums = parts.groupBy("slot").agg(F.sum("c").alias("s"))
        off = sums.withColumn("before", F.sum("s").over(Window.orderBy("slot")) - F.col("s")).select("slot", "before")  # at most 64 rows
        run = parts.join(F.broadcast(off), "slot").withColumn("hi", F.sum("c").over(Window.partitionBy("slot").orderBy(value)) + F.col("before")).withColumn("n", F.lit(n))
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    # the value at a place is the smallest whose cumulated count is beyond it
    aggs = [F.min(F.when(F.col("hi") > at(q), F.col(value))).alias(name) for name, q in qs.items()]
    return run.groupBy(*by).agg(*aggs)


def performance(events: DataFrame) -> DataFrame:
    """total_queries, avg/p50/p95/p99 response time, success and error rate."""
    e = events.where(F.col("event_type").isin("performance", "error"))
    base = e.agg(
        F.count_if(F.col("event_type") == "performance").alias("total_queries"), F.avg(F.when(F.col("event_type") == "performance", F.col("search_time"))).alias("avg_time"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    p = index_percentiles(e.where("event_type = 'performance'"), "search_time", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    total = F.col("total_queries") + F.col("errors")
    one = base.withColumn("k", F.lit(1)).join(p.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("error_rate", F.when(total > 0, F.col("errors") / total).otherwise(F.lit(0.0))).withColumn("success_rate", 1 - F.col("error_rate"))


def by_strategy(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'performance'").groupBy("strategy").agg(F.count(F.lit(1)).alias("uses"), F.avg("search_time").alias("avg_time"), F.avg("quality.average_score").alias("avg_quality"))


def quality(events: DataFrame) -> DataFrame:
    """Means of the results' quality measures, and the users' satisfaction."""
    r = events.agg(*[F.avg(F.when(F.col("event_type") == "results", F.col(f"quality.{n}"))).alias(n) for n in ("average_score", "diversity", "coverage")], satisfaction())
    return r


def satisfaction() -> Column:
    """Share of interactions that are clicks, exports or shares."""
    return F.coalesce(F.avg(F.when(F.col("event_type") == "interaction", F.col("action").isin("click", "export", "share").cast("double"))), F.lit(0.0)).alias("satisfaction")


def by_query_type(events: DataFrame) -> DataFrame:
    """Queries by type with the mean quality and number of their first results."""
    q = events.where("event_type = 'query'").select("query_id", "query_type")
    w = Window.partitionBy("query_id").orderBy("ts")
    r = events.where("event_type = 'results'").withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "quality", "result_count")
    return q.join(r, "query_id", "left").groupBy("query_type").agg(F.count(F.lit(1)).alias("queries"), F.avg("quality.average_score").alias("avg_quality"), F.avg("result_count").alias("avg_results"))


def result_quality(results: DataFrame) -> DataFrame:
    """Per query of results (query_id, score, title, content): mean, population variance, share of distinct beginnings,
    coverage min(1, n / 10)."""
    head = F.concat(F.substring(F.coalesce("title", F.lit("")), 1, 50), F.substring(F.coalesce("content", F.lit("")), 1, 100))
    return results.groupBy("query_id").agg(F.avg("score").alias("average_score"), F.var_pop("score").alias("score_variance"), (F.count_distinct(head) / F.count(F.lit(1))).alias("diversity"), F.least(F.lit(1.0), F.count(F.lit(1)) / 10).alias("coverage"))


def behavior(events: DataFrame) -> DataFrame:
    """Sessions, queries per session, bounce rate, distinct queries, mean words, click rates, dwell, refinement and
    interaction rates."""
    q, i = F.col("event_type") == "query", F.col("event_type") == "interaction"
    per = events.groupBy("session_id").agg(F.count_if(q).alias("n"))
    sessions = per.agg(F.count(F.lit(1)).alias("sessions"), F.avg("n").alias("queries_per_session"), F.avg((F.col("n") == 1).cast("double")).alias("bounce_rate"))
    click = i & (F.col("action") == "click")
    rest = events.agg(
        F.count_if(q).alias("queries"), F.count_distinct(F.when(q, F.col("query"))).alias("unique_queries"), F.avg(F.when(q, F.size(F.split("query", r"\s+")))).alias("avg_words"),
        F.coalesce(F.try_divide(F.count_if(click), F.count_if(q)), F.lit(0.0)).alias("click_rate"), F.coalesce(F.try_divide(F.count_if(click & (F.col("target_rank") == 1)), F.count_if(click)), F.lit(0.0)).alias("top1_click_rate"),
        F.avg(F.when(i, F.col("dwell_time"))).alias("avg_dwell"),
        F.coalesce(F.try_divide(F.count_if(i & (F.col("action") == "refine_query")), F.count_distinct(F.when(i, F.col("query_id")))), F.lit(0.0)).alias("refinement_rate"),
        F.coalesce(F.try_divide(F.count_distinct(F.when(i & F.col("target_id").isNotNull(), F.struct("query_id", "target_id"))), F.lit(10) * F.count_distinct(F.when(i, F.col("query_id")))), F.lit(0.0)).alias("interaction_rate"),
    )
    return sessions.withColumn("k", F.lit(1)).join(rest.withColumn("k", F.lit(1)), "k").drop("k")


def top_queries(events: DataFrame, n: int = 10, interval: str | None = None) -> DataFrame:
    """The n most frequent queries, in all or (with bucket) of each interval."""
    if interval is not None:
        b = F.window("ts", INTERVALS[interval])["start"].alias("bucket")
        uses = events.where("event_type = 'query'").groupBy(b, F.trim(F.lower("query")).alias("query")).agg(F.count(F.lit(1)).alias("uses"))
        w = Window.partitionBy("bucket").orderBy(F.desc("uses"), "query")
        return uses.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return events.where("event_type = 'query'").groupBy(F.trim(F.lower("query")).alias("query")).agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "query").limit(n)


#: How many of the latest entries each history keeps (fixed values).
HISTORY = {"context": 10, "user": 50, "optimizer": 100, "events": 10_000, "series": 1440}


def latest(df: DataFrame, kind: str, by: list[str] | None = None, order: str = "ts", tie: str = "query_id") -> DataFrame:
    """The latest rows that a history of this kind keeps, of each key in by (or of all)."""
    n = HISTORY[kind]
    if not by:
        return df.orderBy(F.desc(order), F.desc(tie)).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def top_scores(results: DataFrame, n: int = 10) -> DataFrame:
    """query_id, scores: each query's n best scores, best first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = results.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "score"))), lambda x: x["score"]).alias("scores"))


def ordered_union(*lists: Column, most: int | None = None) -> Column:
    """The distinct items of several arrays in order of their first place."""
    out = F.array_distinct(F.concat(*lists))
    return out if most is None else F.slice(out, 1, most)


def realtime(events: DataFrame, now, interval: str = "1 minute") -> DataFrame:
    """As of now: queries of the current interval, mean response time of all, and recent errors: each error counts until
    an interval without its like has passed, one an interval, so with e errors in interval t the count is
    max(0, count + e - 1) at its end."""
    size = F.lit({"1 minute": 60, "1 hour": 3600, "1 day": 86_400}[interval])
    e = events.where(F.col("ts") <= F.lit(now).cast("timestamp"))
    slot = F.floor(F.unix_timestamp("ts") / size)
    last = F.floor(F.unix_timestamp(F.lit(now).cast("timestamp")) / size)
    per = e.where("event_type = 'error'").groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # the reflected sum: what is left is the largest surplus of errors over intervals among all suffixes
    w = Window.orderBy(F.desc("slot"))  # a row an interval with errors
    left = per.withColumn("sum", F.sum("n").over(w)).agg(F.greatest(F.lit(0), F.max(F.col("sum") - (last - F.col("slot")))).alias("recent_errors"))
    rest = e.agg(F.count_if((F.col("event_type") == "query") & (slot == last)).alias("last_queries"), F.avg(F.when(F.col("event_type") == "performance", F.col("search_time"))).alias("avg_time"))
    return rest.withColumn("k", F.lit(1)).join(left.withColumn("k", F.lit(1)), "k").drop("k").fillna(0, ["recent_errors"])


def time_series(events: DataFrame, metric: str, interval: str = "hour") -> DataFrame:
    """bucket, value ascending; a bucket with other events only has value 0. metric: query_count, error_count,
    average_response_time (a mean) or total_response_time."""
    b = F.window("ts", INTERVALS[interval])["start"].alias("bucket")
    kinds = {
        "query_count": F.count_if(F.col("event_type") == "query").cast("double"), "error_count": F.count_if(F.col("event_type") == "error").cast("double"),
        "average_response_time": F.coalesce(F.avg(F.when(F.col("event_type") == "performance", F.col("search_time"))), F.lit(0.0)),
        "total_response_time": F.coalesce(F.sum(F.when(F.col("event_type") == "performance", F.col("search_time"))), F.lit(0.0)),
    }
    return events.groupBy(b).agg(kinds[metric].alias("value")).orderBy("bucket")


def interval_metrics(events: DataFrame, interval: str = "minute", n_top: int = 5) -> DataFrame:
    """By interval: queries, distinct sessions, mean time, errors among queries and errors (error_rate) and by query
    (errors_per_query), satisfying interactions among interactions (satisfaction) and by query
    (satisfaction_per_query), and the n_top most frequent queries, joined by commas."""
    b = F.window("ts", INTERVALS[interval])["start"].alias("bucket")
    q = F.col("event_type") == "query"
    error, pleased = F.col("event_type") == "error", (F.col("event_type") == "interaction") & F.col("action").isin("click", "export", "share")
    share = lambda n, of: F.coalesce(F.try_divide(F.count_if(n), F.count_if(of)), F.lit(0.0))
    out = events.groupBy(b).agg(
        F.count_if(q).alias("queries"), F.count_distinct("session_id").alias("sessions"), F.avg(F.when(F.col("event_type") == "performance", F.col("search_time"))).alias("avg_time"),
        share(error, q | error).alias("error_rate"), share(error, q).alias("errors_per_query"), satisfaction(), share(pleased, q).alias("satisfaction_per_query"),
    )
    lead = top_queries(events, n_top, interval).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("place", "query"))).alias("lead"))  # n_top a bucket
    return out.join(lead.select("bucket", F.array_join("lead.query", ",").alias("top_queries")), "bucket", "left").fillna("", ["top_queries"])


def experiments(events: DataFrame) -> DataFrame:
    """Per experiment and variant: participants and metric sums."""
    x = events.where("event_type = 'experiment'")
    people = x.groupBy("experiment_id", "variant").agg(F.count_distinct("session_id").alias("participants"))
    sums = x.select("experiment_id", "variant", F.explode_outer("metrics").alias("metric", "v")).groupBy("experiment_id", "variant", "metric").agg(F.sum("v").alias("total"))
    return sums.join(people, ["experiment_id", "variant"])


def smoothed(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Exponentially smoothed time by strategy and query length (short up to 20 letters), from 0, in time order.
    The fold is a weighted sum, alpha * (1 - alpha)^(events after), so it is computed without collecting a group."""
    x = events.where("event_type = 'performance'").withColumn("size", F.when(F.length("query") <= 20, "short").otherwise("long"))
    key = ["strategy", "size"]
    # events of an equal instant fold in order of query_id. Days are folded apart and then chained, so that no task
    # sorts a whole group: a day's result is what it adds and how much of the past it leaves
    x = x.withColumn("day", F.to_date("ts"))
    w = Window.partitionBy(*key, "day").orderBy(F.desc("ts"), F.desc("query_id"))
    x = x.withColumn("after", F.row_number().over(w) - 1)
    days = x.groupBy(*key, "day").agg(F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("after")) * F.col("search_time")).alias("adds"), F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy(*key).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return days.groupBy(*key).agg(F.sum(F.col("adds") * F.pow(F.lit(1 - alpha), F.col("later"))).alias("smoothed"))


def latency_stats(df: DataFrame, value: str = "search_time") -> DataFrame:
    base = df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
    p = index_percentiles(df, value, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return base.withColumn("k", F.lit(1)).join(p.withColumn("k", F.lit(1)), "k").drop("k")


def preprocessing_stats(df: DataFrame) -> DataFrame:
    """Over processed texts (text.process structs in column p)."""
    return df.agg(F.count(F.lit(1)).alias("texts"), F.avg("p.original_length").alias("avg_original"), F.avg("p.processed_length").alias("avg_processed"), F.count_if("p.was_truncated").alias("truncated"))


#: Rules (fixed values): name, condition over aggregated metrics, impact.
RECOMMENDATIONS = [
    ("slow_queries", "avg_time > 1000", "high"), ("errors", "error_rate > 0.05", "high"), ("low_quality", "average_score < 0.6", "medium"),
    ("low_satisfaction", "satisfaction < 0.7", "medium"), ("low_click_rate", "click_rate < 0.3", "medium"), ("high_bounce", "bounce_rate > 0.7", "low"),
]


def recommendations(metrics: DataFrame) -> DataFrame:
    """The rules that a row of metrics sets off, high impact first; rules on absent metrics don't count."""
    have = [(n, c, i) for n, c, i in RECOMMENDATIONS if c.split()[0] in metrics.columns]
    rules = F.array(*[F.when(F.expr(c), F.struct(F.lit({"high": 0, "medium": 1, "low": 2}[i]).alias("order"), F.lit(n).alias("name"), F.lit(i).alias("impact"))) for n, c, i in have])
    return metrics.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.*").orderBy("order", "name").select("name", "impact")


def export_csv(events: DataFrame, path: str) -> None:
    events.select(F.unix_millis("ts").alias("timestamp"), F.col("event_type").alias("type"), F.col("session_id").alias("sessionId"), F.col("query_id").alias("queryId")).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def export_json(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)
