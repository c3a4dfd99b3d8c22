"""Result processing, for all queries' results at once: rows of query_id, query, id, rank, title, content,
metadata (JSON), score, and so on."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard


def by_score(column: str = "score") -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc(column), "id")


def quality_filter(df: DataFrame, min_score: float | None = 0.1, most: int = 100) -> DataFrame:
    """Results with a score and some text, the first ``most`` of each query. min_score=None suits fused ranks,
    which are never over a few hundredths."""
    ok = (F.length(F.coalesce("title", F.lit(""))) > 0) | (F.length(F.coalesce("content", F.lit(""))) > 0)
    if min_score is not None:
        ok = ok & (F.col("score") >= min_score)
    return df.where(ok).withColumn("__n", F.row_number().over(by_score())).where(F.col("__n") <= most).drop("__n")


def normalize(df: DataFrame, method: str = "min_max", literal: bool = True) -> DataFrame:
    """normalized_score by query: min_max (0 if all are equal), sigmoid, none; z_score and rank_based are the
    identity when literal, else a z-score and a percent rank."""
    w = Window.partitionBy("query_id")
    s = F.col("score")
    low, high = F.min("score").over(w), F.max("score").over(w)
    if method == "min_max":
        out = F.when(high > low, (s - low) / (high - low)).otherwise(F.lit(0.0))
    elif method == "sigmoid":
        out = 1 / (1 + F.exp(-s))
    elif method == "z_score" and not literal:
        sd = F.stddev_pop("score").over(w)
        out = F.when(sd > 0, (s - F.avg("score").over(w)) / sd).otherwise(F.lit(0.0))
    elif method == "rank_based" and not literal:
        out = 1 - F.percent_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    elif method in ("none", "z_score", "rank_based"):
        out = s
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return df.withColumn("normalized_score", out)


def combine(scores: list[Column], weights: list[float], method: str = "weighted") -> Column:
    """weighted sum, harmonic or geometric mean; other known methods are the weighted sum."""
    w = [float(x) for x in weights]
    if method == "harmonic":
        zero = F.lit(False)
        for s in scores:
            zero = zero | (s == 0)
        return F.when(zero, F.lit(0.0)).otherwise(F.lit(sum(w)) / sum((F.lit(x) / F.nullif(s, F.lit(0.0)) for s, x in zip(scores, w)), F.lit(0.0)))
    if method == "geometric":
        low = F.least(*scores) if len(scores) > 1 else scores[0]
        return F.when(low <= 0, F.lit(0.0)).otherwise(F.exp(sum((F.lit(x) * F.ln(F.greatest(s, F.lit(1e-300))) for s, x in zip(scores, w)), F.lit(0.0)) / F.lit(sum(w))))
    if method not in ("weighted", "rrf", "linear", "bayesian"):
        raise ValueError(f"unknown combination {method!r}")
    return sum((F.lit(x) * s for s, x in zip(scores, w)), F.lit(0.0))


def dedupe_key() -> Column:
    t = F.trim(F.lower(F.coalesce("title", F.lit(""))))
    return F.concat(t, F.lit("|"), F.trim(F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 100))))


def dedupe(df: DataFrame) -> DataFrame:
    """Of each query's results with equal titles and beginnings, the first by rank."""
    w = Window.partitionBy("query_id", "__key").orderBy("rank", "id")
    return df.withColumn("__key", dedupe_key()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n", "__key")


def query_words(q: Column) -> Column:
    """Words of more than two characters, special characters out, quotes trimmed."""
    parts = F.split(F.regexp_replace(q, r"[^A-Za-z0-9_\s\"\-]", " "), r"\s+")
    return F.transform(F.filter(parts, lambda w: F.length(w) > 2), lambda w: F.regexp_replace(w, '^"+|"+$', ""))


def py_query_words(q: str) -> list[str]:
    return [w.strip('"') for w in re.split(r"\s+", re.sub(r'[^A-Za-z0-9_\s"\-]', " ", q)) if len(w) > 2]


def py_snippets(content: str, query: str, max_length: int = 150, context: int = 5, most: int = 3) -> list[str]:
    """Up to ``most`` stretches of words around the first matches of the query's words."""
    wanted = py_query_words(query)
    if not content or not wanted:
        return [content[:max_length]]
    low = content.lower()
    places = sorted({(m.start(), k) for k, w in enumerate(wanted) for m in re.finditer(f"(?={re.escape(w.lower())})", low)})[:most]
    ws = re.split(r"\s+", content)
    starts, at = [], 0
    for w in ws:
        starts.append(at)
        at += len(w) + 1
    out: list[str] = []
    seen: set[tuple[int, int]] = set()
    for place, _ in places:
        i = next((j for j, s in enumerate(starts) if s >= place), len(ws) - 1)
        a, z = max(0, i - context), min(len(ws), i + context + 1)
        if (a, z) in seen:
            continue
        seen.add((a, z))
        s = " ".join(ws[a:z])
        s = s[:max_length] + "..." if len(s) > max_length else s
        out.append(("..." if a else "") + s + ("..." if z < len(ws) else ""))
    return out or [content[:max_length] + ("..." if len(content) > max_length else "")]


def snippets(df: DataFrame, max_length: int = 150, context: int = 5, most: int = 3) -> DataFrame:
    """df with an array of snippets (a pandas UDF: offsets of every match aren't a column expression)."""

    @F.pandas_udf("array<string>")
    def udf(content: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([py_snippets(c or "", q or "", max_length, context, most) for c, q in zip(content, query)])

    return df.withColumn("snippets", udf("content", "query"))


def highlight(texts: Column, query: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Each text with the query's words wrapped, whole words in any case, one word after the other."""
    wrap = lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])(\Q"), w, F.lit(r"\E)(?![A-Za-z0-9_])")), F.lit(f"{before}$1{after}"))
    return F.transform(texts, lambda t: F.aggregate(F.filter(query_words(query), lambda w: F.length(w) > 0), t, wrap))


def snippet_score(texts: Column, query: Column) -> Column:
    """Mean share of the query's words that a text has."""
    ws = query_words(query)
    share = lambda t: F.size(F.filter(ws, lambda w: F.contains(F.lower(t), F.lower(w)))) / F.greatest(F.size(ws), F.lit(1))
    return F.when(F.size(texts) > 0, F.aggregate(texts, F.lit(0.0), lambda a, t: a + share(t)) / F.size(texts)).otherwise(F.lit(0.0))


def metadata_keys(c: Column) -> Column:
    return F.coalesce(F.size(F.json_object_keys(c)), F.lit(0))


def quality_score(has_snippets: Column | None = None) -> Column:
    """0.5 and bonuses for a title, length, snippets and metadata, penalties for their lack; 0 to 1."""
    title, content = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("content", F.lit("")))
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    s = F.lit(0.5) + add(title > 10, 0.1) + add(content > 100, 0.1) + add(metadata_keys(F.col("metadata")) > 0, 0.05)
    if has_snippets is not None:
        s = s + add(has_snippets, 0.1)
    s = s + add((content > 0) & (content < 50), -0.1) + add(title == 0, -0.05)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def diversity_score(df: DataFrame) -> DataFrame:
    """1 - mean similarity of a result's words with those of the first five results before it."""
    ws = F.array_distinct(F.split(F.lower(F.coalesce("content", F.lit(""))), r"\s+"))
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    df = df.withColumn("__w", ws).withColumn("__i", F.row_number().over(w))
    # the first five results of each query are all that anyone is compared with
    lead = df.where(F.col("__i") <= 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__w").alias("w")))).alias("__lead"))
    df = df.join(lead, "query_id")
    before = F.filter("__lead", lambda x: x["i"] < F.col("__i"))
    mean = F.aggregate(before, F.lit(0.0), lambda a, x: a + jaccard(F.col("__w"), x["w"])) / F.size(before)
    return df.withColumn("diversity_score", F.when(F.size(before) > 0, 1 - mean).otherwise(F.lit(1.0))).drop("__w", "__i", "__lead")


def context_score(df: DataFrame, history: DataFrame | None = None, profile_keys: Column | None = None) -> DataFrame:
    """0.5, up to 0.3 for past queries (user_id, query, interaction) that contain the query or are contained in
    it, and up to 0.2 for the number of profile entries. df needs user_id and query when history is given."""
    s = F.lit(0.5)
    if history is not None:
        value = F.when(F.col("h.interaction") == "clicked", 1.0).when(F.col("h.interaction") == "refined", 0.5).otherwise(0.0)
        asked = df.select("query_id", "user_id", "query").distinct().alias("a")
        a, h = F.lower(F.col("a.query")), F.lower(F.col("h.query"))
        past = asked.join(history.alias("h"), (F.col("a.user_id") == F.col("h.user_id")) & (F.contains(a, h) | F.contains(h, a)))
        df = df.join(past.groupBy(F.col("a.query_id").alias("query_id")).agg(F.avg(value).alias("__past")), "query_id", "left")
        s = s + 0.3 * F.coalesce("__past", F.lit(0.0))
    if profile_keys is not None:
        s = s + F.least(F.lit(0.2), 0.05 * profile_keys)
    return df.withColumn("context_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))).drop("__past")


def rerank(df: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """reranking_score, final_score and the new rank."""
    df = diversity_score(df) if "diversity_score" not in df.columns else df
    df = context_score(df, history) if "context_score" not in df.columns else df
    has = F.size("snippets") > 0 if "snippets" in df.columns else None
    base = F.coalesce(F.nullif(F.col("normalized_score"), F.lit(0.0)), F.col("score")) if "normalized_score" in df.columns else F.col("score")
    mixed = combine([base, F.col("diversity_score"), F.col("context_score"), quality_score(has)], [0.6, 0.15, 0.15, 0.1])
    df = df.withColumn("reranking_score", mixed).withColumn("final_score", base * 0.7 + F.col("reranking_score") * 0.3)
    return df.withColumn("rank", F.row_number().over(by_score("final_score")))


def cluster_best(df: DataFrame, score: str = "score") -> DataFrame:
    """The best result of each query and cluster: the first three words of the title."""
    key = F.array_join(F.slice(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\s+"), 1, 3), "_")
    df = df.withColumn("cluster_key", F.when(F.length(key) > 0, key).otherwise(F.lit("misc")))
    w = Window.partitionBy("query_id", "cluster_key").orderBy(F.desc(score), "id")
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def explanation() -> Column:
    """struct<total_score, components, formula> of a processed result."""
    part = lambda n, c, w, d: F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("name"), F.col(c).alias("score"), F.lit(w).alias("weight"), F.lit(d).alias("details")))
    parts = F.array(
        part("base", "score", 0.6, "score of the channels"), part("reranking", "reranking_score", 0.3, "context and quality"),
        part("diversity", "diversity_score", 0.15, "difference from earlier results"), part("snippet", "snippet_score", 0.1, "share of query words in snippets"),
    )
    return F.struct(F.col("final_score").alias("total_score"), F.filter(parts, lambda p: p.isNotNull()).alias("components"), F.lit("0.6 base + 0.3 reranking + 0.15 diversity + 0.1 snippet").alias("formula"))


def process(df: DataFrame, history: DataFrame | None = None, min_score: float | None = None, method: str = "min_max", with_highlight: bool = True) -> DataFrame:
    """The whole chain: filter, normalise, deduplicate, snippets, highlights, rerank, explain, ranks."""
    df = dedupe(normalize(quality_filter(df, min_score), method))
    df = snippets(df)
    df = df.withColumn("snippet_score", snippet_score(F.col("snippets"), F.col("query")))
    if with_highlight:
        df = df.withColumn("highlights", F.create_map(F.lit("content"), highlight(F.col("snippets"), F.col("query"))))
    df = rerank(df, history)
    return df.withColumn("explanation", explanation())


def preference_update(interactions: DataFrame) -> DataFrame:
    """user_id, quality_threshold, diversity_preference, snippet_length after a user's interactions
    (user_id, ts, action, duration, snippet_used), in order of ts: a fold over each user's sorted array."""
    seq = F.array_sort(F.collect_list(F.struct("ts", "action", "duration", "snippet_used")))
    zero = F.struct(F.lit(0.1).alias("q"), F.lit(0.3).alias("d"), F.lit(150.0).alias("s"))

    def step(a: Column, x: Column) -> Column:
        return F.struct(
            F.when(x["action"] == "click", F.least(F.lit(1.0), a["q"] + 0.01)).otherwise(a["q"]).alias("q"),
            F.when((x["action"] == "dwell") & (x["duration"] > 5000), F.greatest(F.lit(0.0), a["d"] - 0.05)).when(x["action"] == "skip", F.least(F.lit(1.0), a["d"] + 0.02)).otherwise(a["d"]).alias("d"),
            F.when(x["snippet_used"], F.least(F.lit(300.0), a["s"] * 1.1)).otherwise(a["s"]).alias("s"),
        )

    got = interactions.groupBy("user_id").agg(F.aggregate(seq, zero, step).alias("p"))
    return got.select("user_id", F.col("p.q").alias("quality_threshold"), F.col("p.d").alias("diversity_preference"), F.col("p.s").alias("snippet_length"))


def adaptive_filter(df: DataFrame, preferences: DataFrame, most: int = 20) -> DataFrame:
    """Results over the user's threshold; users who prefer diversity (over 0.5) with more than five results get
    only those unlike what they already have. Greedy, so one query at a time, of its first 100 results."""
    df = df.join(preferences, "user_id", "left").withColumn("quality_threshold", F.coalesce("quality_threshold", F.lit(0.1))).withColumn("diversity_preference", F.coalesce("diversity_preference", F.lit(0.3)))
    df = df.where(F.col("score") >= F.col("quality_threshold"))
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("__n") <= 100).drop("__n")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"])
        like = float(pdf["diversity_preference"].iloc[0])
        if like <= 0.5 or len(pdf) <= 5:
            return pdf
        chosen: list[int] = []
        sets: list[set[str]] = []
        heads: set[str] = set()
        for i, (t, c) in enumerate(zip(pdf["title"].fillna(""), pdf["content"].fillna(""))):
            ws, head = set(re.split(r"\s+", f"{t} {c}")), f"{t} {c[:200]}"
            if not chosen or (head not in heads and max(len(ws & s) / len(ws | s) for s in sets) <= 1 - like):
                chosen.append(i)
                sets.append(ws)
                heads.add(head)
            if len(chosen) >= most:
                break
        return pdf.iloc[chosen]

    return df.groupBy("query_id").applyInPandas(pick, df.schema)


