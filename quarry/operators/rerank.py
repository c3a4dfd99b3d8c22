"""Re-ranking of results: features, scores, diversification and personalisation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..functions.text import jaccard, words
from .results import metadata_keys

FEATURES = 50
DAY_MS = 86_400_000.0


def features(now_ms: Column | None = None) -> Column:
    """array<double> of FEATURES values, of which the first 13 are set."""
    asked, title, content = words(F.col("query")), words(F.col("title")), words(F.col("content"))
    share = lambda ws: F.size(F.filter(asked, lambda w: F.array_contains(ws, w))) / F.greatest(F.size(asked), F.lit(1))
    stamp = F.get_json_object("metadata", "$.timestamp").try_cast("double")
    age = ((now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())) - stamp) / DAY_MS
    fresh = F.when(stamp.isNotNull() & (stamp != 0), F.greatest(F.lit(0.0), 1 - age / 365)).otherwise(F.lit(0.5))
    zero = F.lit(0.0)
    made = [
        F.coalesce("score", zero), F.coalesce("normalized_score", zero), F.coalesce("fts_score", zero), F.coalesce("vec_score", zero),
        F.length(F.coalesce("title", F.lit(""))) / 100, F.length(F.coalesce("content", F.lit(""))) / 1000, F.coalesce(F.size("snippets"), F.lit(0)),
        share(title), share(content), F.col("rank") / 100, metadata_keys(F.col("metadata")) / 10, fresh, F.when(F.length("collection") > 0, 1.0).otherwise(0.0),
    ]
    return F.concat(F.array(*[c.cast("double") for c in made]), F.array_repeat(F.lit(0.0), FEATURES - len(made)))


def ml_score(f: Column) -> Column:
    """Weighted features in 0 to 1: a stand-in for a trained ranker."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), f[0] * 0.4 + f[7] * 0.3 + f[11] * 0.2 + f[10] * 0.1))


def with_ranks(df: DataFrame, score: str = "final_score") -> DataFrame:
    """rank by score and rank_change from original_rank."""
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "original_rank")))
    return df.withColumn("rank_change", F.col("original_rank") - F.col("rank"))


def ml_rerank(df: DataFrame, now_ms: Column | None = None) -> DataFrame:
    df = df.withColumn("original_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    df = df.withColumn("features", features(now_ms)).withColumn("ml_score", ml_score(F.col("features")))
    return with_ranks(df.withColumn("final_score", 0.7 * F.col("score") + 0.3 * F.col("ml_score")))


def greedy(scores: list[float], sets: list[set[str]], alpha: float, beta: float, most: int | None = None) -> list[tuple[int, float]]:
    """(index, diversity) in the order of choice: the first, then always the best alpha * score + beta * (1 - mean
    similarity to those chosen)."""
    if not scores:
        return []
    chosen, left = [(0, 1.0)], list(range(1, len(scores)))
    total = [0.0] * len(scores)
    last = 0
    while left and (most is None or len(chosen) < most):
        best, top, gain = -1, float("-inf"), 0.0
        for i in left:
            union = len(sets[i] | sets[last])
            total[i] += len(sets[i] & sets[last]) / union if union else 0.0
            d = max(0.0, 1 - total[i] / len(chosen))
            v = alpha * scores[i] + beta * d
            if v > top:
                best, top, gain = i, v, d
        chosen.append((best, gain))
        left.remove(best)
        last = best
    return chosen


def diversify(df: DataFrame, how: str = "semantic", most: int = 100) -> DataFrame:
    """Order each query's results anew: semantic (0.7 / 0.3) and mmd (0.6 / 0.4) are greedy, so they take one
    query at a time, of its ``most`` best results; cluster and round_robin are windows over all of them. Adds
    position and diversity_score."""
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    if how in ("semantic", "mmd"):
        df = df.where(F.col("__n") <= most)
        alpha, beta = (0.7, 0.3) if how == "semantic" else (0.6, 0.4)

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__n")
            sets = [set(re.split(r"\s+", f"{t or ''} {c or ''}".lower())) for t, c in zip(pdf["title"], pdf["content"])]
            order = greedy(pdf["score"].tolist(), sets, alpha, beta, None if how == "semantic" else most)
            out = pdf.iloc[[i for i, _ in order]].copy()
            out["position"] = range(1, len(order) + 1)
            out["diversity_score"] = [d for _, d in order]
            return out.drop(columns="__n")

        base = df.drop("__n").schema
        return df.groupBy("query_id").applyInPandas(pick, base.add("position", IntegerType()).add("diversity_score", DoubleType()))
    if how == "cluster":
        key = F.concat(F.lit("cluster_"), F.array_join(F.slice(F.split(F.lower(F.coalesce("title", F.lit("untitled"))), r"\s+"), 1, 2), "_"))
        return df.withColumn("cluster_id", key).withColumn("position", F.col("__n")).withColumn("diversity_score", F.lit(0.8)).drop("__n")
    if how == "round_robin":
        kind = F.get_json_object("metadata", "$.type")
        df = df.withColumn("group_key", F.coalesce(F.nullif("collection", F.lit("")), F.nullif("source", F.lit("")), kind, F.lit("default")))
        turn = F.row_number().over(Window.partitionBy("query_id", "group_key").orderBy("__n"))
        seen = F.min("__n").over(Window.partitionBy("query_id", "group_key"))
        df = df.withColumn("turn", turn).withColumn("__seen", seen)
        return df.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "__seen"))).withColumn("diversity_score", F.lit(0.8)).drop("__n", "__seen")
    raise ValueError(f"unknown diversification {how!r}")


def personalize(df: DataFrame, clicks: DataFrame | None = None, session: DataFrame | None = None, profile: DataFrame | None = None, weight: float = 0.1,
                click_weight: float = 0.3, session_weight: float = 0.2, profile_weight: float = 0.3, decay: float = 0.95) -> DataFrame:
    """score * (1 + weight * p): p from the share of the user's clicked queries (user_id, query) that share over
    30 % of their words with a result, its mean similarity to the session's last five results (user_id, ts,
    title, content), and the weights of profile words (user_id, preference, weight, days_idle) in its text."""
    df = df.withColumn("original_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    df = df.withColumn("__w", F.array_distinct(words(text)))
    parts = F.lit(0.0)
    if clicks is not None:
        # clicks of equal words are one row with a count; results and clicks meet by user, and only sums stay
        asked = clicks.groupBy("user_id", F.array_sort(F.array_distinct(words(F.col("query")))).alias("__c")).agg(F.count(F.lit(1)).alias("__m"))
        met = df.select("query_id", "id", "user_id", "__w").join(asked, "user_id")
        near = F.size(F.array_intersect("__c", "__w")) / F.greatest(F.size("__c"), F.lit(1)) > 0.3
        share = met.groupBy("query_id", "id").agg((F.sum(F.when(near, F.col("__m")).otherwise(0)) / F.sum("__m")).alias("__share"))
        df = df.join(share, ["query_id", "id"], "left")
        parts = parts + F.coalesce("__share", F.lit(0.0)) * click_weight
    if session is not None:
        last = F.slice(F.sort_array(F.collect_list(F.struct("ts", F.array_distinct(words(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))).alias("w"))), asc=False), 1, 5)
        df = df.join(session.groupBy("user_id").agg(last.alias("__session")), "user_id", "left")
        mean = F.aggregate("__session", F.lit(0.0), lambda a, s: a + jaccard(F.col("__w"), s["w"])) / F.size("__session")
        parts = parts + F.when(F.size("__session") > 0, mean).otherwise(F.lit(0.0)) * session_weight
    idle = F.lit(0.0)
    if profile is not None:
        got = profile.groupBy("user_id").agg(F.collect_list(F.struct(F.lower("preference").alias("p"), "weight")).alias("__profile"), F.min("days_idle").alias("__idle"))
        df = df.join(got, "user_id", "left")
        low = F.lower(text)
        sum_ = F.aggregate("__profile", F.lit(0.0), lambda a, x: a + F.when(F.contains(low, x["p"]), x["weight"]).otherwise(F.lit(0.0)))
        parts = parts + F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum_)), F.lit(0.0)) * profile_weight
        idle = F.coalesce("__idle", F.lit(0.0))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), parts * F.pow(F.lit(decay), idle)))
    df = df.withColumn("personal_score", p).withColumn("final_score", F.col("score") * (1 + weight * F.col("personal_score")))
    return with_ranks(df).drop("__w", "__share", "__session", "__profile", "__idle")


def profile_update(queries: DataFrame) -> DataFrame:
    """user_id, preference, weight: 0.1 for each use of a word of more than three letters, at most 1."""
    each = queries.select("user_id", F.explode(F.filter(words(F.col("query")), lambda w: F.length(w) > 3)).alias("preference"))
    return each.groupBy("user_id", "preference").agg(F.least(F.lit(1.0), F.round(0.1 * F.count(F.lit(1)), 10)).alias("weight"))


def feedback_rows(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Training rows: a result's features and its relevance, 1 clicked, 0.5 refined, else 0."""
    value = F.when(F.col("interaction") == "clicked", 1.0).when(F.col("interaction") == "refined", 0.5).otherwise(0.0)
    return results.join(feedback.select("query_id", "id", "interaction"), ["query_id", "id"]).withColumn("relevance", value)


def optimizer_metrics(runs: DataFrame) -> DataFrame:
    """Means over runs (ms, relevance_gain, diversified)."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.avg("ms").alias("avg_ms"), F.avg("relevance_gain").alias("avg_gain"), F.avg(F.col("diversified").cast("double")).alias("diversification_rate"))
