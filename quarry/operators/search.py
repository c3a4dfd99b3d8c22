"""Retrieval: BM25, nearest neighbours, substring search and their fusion, for one query or many.

Every operator takes queries as a DataFrame (query_id and what it asks) and carries only
(query_id, rowid, scores) until the end; documents are attached last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import substrings, vectors
from ..functions.text import ascii_fold, tokens
from . import match
from .index import TextIndex

K1, B, RRF_K = 1.2, 0.75, 60
#: Words that substring search refuses (fixed values).
LIKE_STOP = "the is at which on a an to in for of and or but are was were been be have has".split()
LIKE_MIN, LIKE_CAP = 3, 100
#: Query rows up to this many are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000
MAX_QUERY_VECTORS = 10_000
#: Substrings up to this many are looked for one by one.
FEW_NEEDLES = 16


#: Distinct query terms up to this many are looked up by name; more are joined.
MAX_NAMED_TERMS = 2_000


def _small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df (queries, cheap to count) marked for broadcast if it is checked to have at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def top(df: DataFrame, n: int | Column, *order: Column, by: str = "query_id") -> DataFrame:
    """The first n rows of each query (a group limit before the shuffle does most of it)."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def bm25_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct tokens of each query's text."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def bm25(index: TextIndex, queries: DataFrame, operator: str = "or", restrict: DataFrame | None = None, stats_scope: str = "corpus", weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, rowid, fts_score of the documents that have any (operator "or") or all ("and") of a query's
    tokens; lower is better, as in FTS5. restrict (rowid) filters what is returned; stats_scope "collection"
    makes it the scope of the statistics too. weights by field multiply term frequencies."""
    if operator not in ("or", "and"):
        raise ValueError(f"unknown operator {operator!r}")
    asked = bm25_terms(queries)
    # fetched once, since they are asked for by name below; a projection of local rows needs no job
    rows = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).limit(MAX_BROADCAST_ROWS + 1).collect()
    pairs = [(r.query_id, t) for r in rows for t in r.terms]
    few = len(rows) <= MAX_BROADCAST_ROWS and len(pairs) <= 4 * MAX_BROADCAST_ROWS
    terms = asked.sparkSession.createDataFrame(pairs, asked.schema) if few else asked
    names = sorted({t for _, t in pairs}) if few else []
    named = few and len(names) <= MAX_NAMED_TERMS
    pick = (lambda df: index.of(df, names)) if named else (lambda df: df)
    hits = pick(index.postings)
    scope = restrict if stats_scope == "collection" else None
    if scope is not None:
        hits = hits.join(scope, "rowid", "left_semi")
    hits = hits.select("rowid", "term", "tf", "field_tf", "dl").join(F.broadcast(terms) if few else terms, "term")
    return _scored(index, hits, terms, few, operator, restrict, scope, weights, pick)


def _scored(index: TextIndex, hits: DataFrame, terms: DataFrame, few: bool, operator: str, restrict: DataFrame | None, scope: DataFrame | None, weights: dict[str, float] | None, pick: Callable) -> DataFrame:
    """hits: rowid, term, tf, field_tf, dl, query_id. There are no more idf rows than terms."""
    if index.frequencies is not None and scope is None:
        df = pick(index.frequencies).select("term", "df")
    else:
        df = hits.select("term", "rowid").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = index.stats(scope).first() if scope is not None else index.totals()
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = df.select("term", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"))
    tf = F.col("tf").cast("double")
    if weights:
        parts = [F.get("field_tf", F.lit(i)) * F.lit(float(weights.get(f, 1.0))) for i, f in enumerate(index.fields)]
        tf = sum(parts[1:], parts[0])
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    rows = hits.join(F.broadcast(known) if few else known, "term")
    if restrict is not None and scope is None:
        rows = rows.join(restrict, "rowid", "left_semi")
    out = rows.groupBy("query_id", "rowid").agg(F.round(-F.sum(part), 9).alias("fts_score"), F.count(F.lit(1)).alias("__n"))  # rounded: ties stay ties whatever the order of the sum
    if operator == "and":
        need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("__need"))
        out = out.join(F.broadcast(need) if few else need, "query_id").where(F.col("__n") == F.col("__need")).drop("__need")
    return out.drop("__n")


def fts(index: TextIndex, query: str, operator: str = "and", restrict: DataFrame | None = None, weights: dict[str, float] | None = None, query_id: int = 0) -> DataFrame:
    """query_id, rowid, fts_score of one query in full syntax (phrases, prefixes, NOT, columns, NEAR)."""
    spark = index.postings.sparkSession
    tree = match.parse(query, operator)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rowid long, fts_score double")
    exact, prefixes = match.all_terms(tree)
    wanted = F.col("term").isin(exact)
    for p in prefixes:
        wanted = wanted | F.col("term").startswith(p)
    hits = index.postings.where(wanted) if prefixes else index.of(index.postings, exact)
    found = F.collect_list(F.struct("term", "positions"))
    per_doc = hits.groupBy("rowid").agg(found.alias("found"))
    ok = per_doc.where(match.predicate(tree, F.col("found"), index.fields)).select("rowid")
    scored, lead = match.positive_terms(tree)
    counts = F.col("term").isin(scored)
    for p in lead:
        counts = counts | F.col("term").startswith(p)
    # a prefix counts as one phrase: its terms' frequencies add up
    key = F.col("term")
    for p in lead:
        key = F.when(F.col("term").startswith(p) & ~F.col("term").isin(scored), F.lit(p + "*")).otherwise(key)
    merged = hits.where(counts).withColumn("term", key).groupBy("rowid", "term").agg(F.sum("tf").alias("tf"), F.array(*[F.sum(F.get("field_tf", F.lit(i))) for i in range(len(index.fields))]).alias("field_tf"), F.first("dl").alias("dl"))
    names = [*scored, *[p + "*" for p in lead]]
    asked = spark.createDataFrame([(query_id, t) for t in names], "query_id long, term string")
    view = TextIndex(merged, index.lengths, index.fields, _stats=list(index.totals()))
    rows = merged.join(F.broadcast(asked), "term")
    return _scored(view, rows, asked, True, "or", ok if restrict is None else ok.join(restrict, "rowid", "left_semi"), None, weights, lambda df: df)


def knn(items: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", threshold: float | None = None, restrict: DataFrame | None = None, prefilter: bool = True) -> DataFrame:
    """query_id, rowid, distance of the k nearest items (rowid, embedding) of each query (query_id, vector),
    exactly: queries go to where the vectors are, a task compares them by blocks (one matrix product finds the
    candidates, whose distances are then computed one by one) and keeps k for each query, and only those move.
    Vectors of other sizes than the query's, null ones and null components match nothing. prefilter=False takes the
    k nearest of all items and filters afterwards, so fewer may be left."""
    if metric not in vectors.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    rows = asked.limit(MAX_QUERY_VECTORS + 1).toArrow()
    if rows.num_rows > MAX_QUERY_VECTORS:
        raise ValueError(f"more than {MAX_QUERY_VECTORS} queries; ask in blocks")
    if restrict is not None and prefilter:
        items = items.join(restrict, "rowid", "left_semi")
    kinds = dict(asked.dtypes)["query_id"], dict(items.select("rowid").dtypes)["rowid"]
    shared = items.sparkSession.sparkContext.broadcast(vectors.Queries(rows.column(0).to_pylist(), rows.column(1).to_pylist()))  # counted above

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shared.value.nearest(batches, k, metric, threshold)

    near = items.select("rowid", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(task, f"query_id {kinds[0]}, rowid {kinds[1]}, distance double")
    near = top(near, k, F.col("distance"), F.col("rowid"))
    return near.join(restrict, "rowid", "left_semi") if restrict is not None and not prefilter else near


def like_skip_reason(text: str | None) -> str | None:
    """Why substring search refuses a query: too_short or stop_word."""
    t = (text or "").strip()
    if len(t) < LIKE_MIN:
        return "too_short"
    return "stop_word" if t.lower() in LIKE_STOP else None


def like_skip_column(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) < LIKE_MIN, "too_short").when(F.lower(t).isin(LIKE_STOP), "stop_word")


def like(docs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, rowid, like_rank (from 0) of documents (rowid, title, content) that contain a query's text,
    A-Z in any case: title hits first, then by place, then shorter ones; at most min(2 limit, 100). One automaton
    of all queries reads each text once, however many queries there are."""
    asked = queries.where(like_skip_column(F.col("text")).isNull()).select("query_id", ascii_fold(F.trim("text")).alias("needle"))
    if asked.limit(MAX_BROADCAST_ROWS + 1).count() > MAX_BROADCAST_ROWS:
        raise ValueError(f"more than {MAX_BROADCAST_ROWS} queries; ask in blocks")
    rows = asked.collect()  # counted above
    kinds = dict(asked.dtypes)["query_id"], dict(docs.select("rowid").dtypes)["rowid"]
    if len(rows) <= FEW_NEEDLES:  # a few are looked for one by one, without leaving the JVM
        needles = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), F.lit(r.needle).alias("needle")) for r in rows])
        t, c = F.col("t"), F.col("c")
        there = lambda n: F.coalesce(F.contains(t, n["needle"]), F.lit(False)) | F.coalesce(F.contains(c, n["needle"]), F.lit(False))
        # full lower case is quicker than folding A-Z and keeps all that could match
        low = [F.lower(F.coalesce(x, F.lit(""))) for x in ("title", "content")]
        may = [F.contains(x, F.lower(F.lit(r.needle))) for r in rows for x in low]
        d = docs.where(reduce(or_, may, F.lit(False))).select("rowid", ascii_fold(F.col("title")).alias("t"), ascii_fold(F.col("content")).alias("c"))
        hits = d.select("rowid", "t", "c", F.explode(F.filter(needles, there)).alias("n")).select("rowid", "t", "c", "n.*") if rows else d.select("rowid", "t", "c", F.lit(None).cast(kinds[0]).alias("query_id"), F.lit("").alias("needle")).limit(0)
        in_title = F.coalesce(F.contains("t", "needle"), F.lit(False))
        hits = hits.select("query_id", "rowid", F.when(in_title, 1).otherwise(2).alias("cls"), F.coalesce(F.expr("instr(t, needle)"), F.expr("instr(c, needle)")).alias("place"), F.length("c").alias("len"))
        return _like_ranked(hits, limit)
    shared = docs.sparkSession.sparkContext.broadcast([(r.query_id, r.needle) for r in rows])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return substrings.find(shared.value, batches)

    d = docs.select("rowid", ascii_fold(F.col("title")).alias("t"), ascii_fold(F.col("content")).alias("c"))
    hits = d.mapInArrow(task, f"query_id {kinds[0]}, rowid {kinds[1]}, cls int, place int, len int")
    return _like_ranked(hits, limit)


def _like_ranked(hits: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("cls", "place", "len", "rowid")
    return hits.withColumn("like_rank", F.row_number().over(w) - 1).where(F.col("like_rank") < min(2 * limit, LIKE_CAP)).select("query_id", "rowid", "like_rank")


@dataclass
class Weights:
    fts: float = 0.6
    vec: float = 0.4
    like: float | None = None

    def check(self) -> None:
        if self.like is not None and abs(self.fts + self.vec + self.like - 1) > 0.01:
            raise ValueError("weights have to sum to 1")


def fuse(fts_hits: DataFrame | None = None, vec_hits: DataFrame | None = None, like_hits: DataFrame | None = None, method: str = "rrf", limit: int | None = 10,
         weights: Weights | None = None, rrf_k: int = RRF_K, custom: Callable[..., Column] | None = None) -> DataFrame:
    """Fuse channels by one union and one aggregation: query_id, rowid, score, fts_score, vec_score, like_rank.
    fts and vec ranks start at 1 with ties shared, like ranks at 0; a missing channel adds nothing."""
    if method not in ("rrf", "weighted", "weighted_rrf", "custom"):
        raise ValueError(f"unknown fusion method {method!r}")
    w = weights or Weights()
    if method == "weighted_rrf" or method == "weighted":
        w.check()
    w_like = w.like if w.like is not None else (0.2 if fts_hits is not None and vec_hits is not None else 0.3)
    none = {"fts_score": "double", "fts_rank": "int", "distance": "double", "vec_rank": "int", "like_rank": "int"}

    def channel(df: DataFrame, **have: Column) -> DataFrame:
        return df.select("query_id", "rowid", *[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()])

    by = lambda c: F.rank().over(Window.partitionBy("query_id").orderBy(c))
    parts = []
    if fts_hits is not None:
        parts.append(channel(fts_hits, fts_score=F.col("fts_score"), fts_rank=by("fts_score")))
    if vec_hits is not None:
        parts.append(channel(vec_hits, distance=F.col("distance"), vec_rank=by("distance")))
    if like_hits is not None:
        parts.append(channel(like_hits, like_rank=F.col("like_rank")))
    if not parts:
        raise ValueError("a search needs a text or a vector")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    rows = both.groupBy("query_id", "rowid").agg(*[F.max(n).alias(n) for n in none])
    if method == "rrf":
        score = sum((F.coalesce(1.0 / (rrf_k + F.col(n)), F.lit(0.0)) for n in ("fts_rank", "vec_rank", "like_rank")), F.lit(0.0))
    elif method == "custom":
        if custom is None:
            raise ValueError("custom fusion needs a function of the channels' columns")
        score = custom(*[F.col(n) for n in none])
    else:
        score = w.fts * F.coalesce(-F.col("fts_score"), F.lit(0.0)) + w.vec * F.coalesce(1 / (1 + F.col("distance")), F.lit(0.0)) + w_like * F.coalesce(1.0 / (1 + F.col("like_rank")), F.lit(0.0))
    out = rows.select(
        "query_id", "rowid", score.alias("score"), F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"),
        F.coalesce("distance", F.lit(1.0)).alias("vec_score"), F.coalesce("like_rank", F.lit(-1)).alias("like_rank"),
    )
    return out if limit is None else top(out, limit, F.desc("score"), F.col("rowid"))


def attach(hits: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """hits with the documents' columns; likeScore from like_rank. most: how many hits there are at most, if known."""
    like_score = F.when(F.col("like_rank") >= 0, 1.0 / (1 + F.col("like_rank")))
    rows = hits.withColumn("like_score", like_score) if "like_rank" in hits.columns else hits
    return docs.join(_small(rows) if most is None or most > MAX_BROADCAST_ROWS else F.broadcast(rows), "rowid")


@dataclass
class SearchResult:
    hits: DataFrame
    debug: dict = field(default_factory=dict)


def search(docs: DataFrame, index: TextIndex | None, items: DataFrame | None, queries: DataFrame, limit: int = 10, method: str = "rrf", weights: Weights | None = None,
           enable_like: bool = False, operator: str | None = None, metric: str = "l2", restrict: DataFrame | None = None, prefilter: bool = True,
           rrf_k: int = RRF_K, custom: Callable[..., Column] | None = None, field_weights: dict[str, float] | None = None, threshold: float | None = None) -> SearchResult:
    """Search by what queries hold: text, vector or both. Text alone matches any word; with vectors all words.
    rrf_k and custom reach the fusion, field_weights the text channel, threshold (a distance) the vector channel."""
    has_text, has_vec = "text" in queries.columns and index is not None, "vector" in queries.columns and items is not None
    if not has_text and not has_vec:
        raise ValueError("a search needs a text or a vector")
    operator = operator or ("and" if has_vec else "or")
    f = v = None
    if has_text:
        f = top(bm25(index, queries, operator, restrict, weights=field_weights), limit, F.col("fts_score"), F.col("rowid"))
    if has_vec:
        v = knn(items, queries, limit, metric, threshold, restrict, prefilter)
    li = like(docs if restrict is None else docs.join(restrict, "rowid", "left_semi"), queries, limit) if has_text and enable_like else None
    debug = {"method": method, "channels": [n for n, x in (("fts", f), ("vec", v), ("like", li)) if x is not None], "operator": operator, "limit": limit, "like": li is not None, "fusion": len([x for x in (f, v, li) if x is not None]) > 1}
    if f is not None and v is None and li is None:
        hits = f.select("query_id", "rowid", (-F.col("fts_score")).alias("score"), "fts_score", F.lit(0.0).alias("vec_score"), F.lit(-1).alias("like_rank"))
    elif v is not None and f is None:
        hits = v.select("query_id", "rowid", (1 / (1 + F.col("distance"))).alias("score"), F.lit(0.0).alias("fts_score"), F.col("distance").alias("vec_score"), F.lit(-1).alias("like_rank"))
    else:
        hits = fuse(f, v, li, method, limit, weights, rrf_k, custom)
    return SearchResult(hits, debug)


def semantic(items: DataFrame, queries: DataFrame, dimensions: int, k: int = 10, threshold: float = 0.1, metric: str = "cosine") -> DataFrame:
    """Embed the queries' texts and return items within threshold: query_id, rowid, distance, score = 1 - distance."""
    asked = queries.select("query_id", vectors.hash_embedding(F.col("text"), dimensions).alias("vector"))
    return knn(items, asked, k, metric, threshold).withColumn("score", 1 - F.col("distance"))


def merge_collections(hits: DataFrame, how: str = "unified_ranking", limit: int = 10, boosts: dict[str, float] | None = None, max_collections: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One ranking of hits (query_id, collection, rowid, score) of several collections: unified_ranking by boosted
    score, interleave by rank within the collection, or group_by_collection. Adds position."""
    if keep is not None:
        hits = hits.where(keep(F.col("collection")))
    if boosts:
        factor = F.lit(1.0)
        for name, b in sorted(boosts.items()):
            factor = F.when(F.col("collection") == name, F.lit(float(b))).otherwise(factor)
        hits = hits.withColumn("score", F.col("score") * factor)
    inner = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "rowid")
    rows = hits.withColumn("rank_in_collection", F.row_number().over(inner)).where(F.col("rank_in_collection") <= limit)
    if max_collections is not None:
        best = Window.partitionBy("query_id").orderBy(F.desc("best"), "collection")
        lead = rows.groupBy("query_id", "collection").agg(F.max("score").alias("best")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_collections)
        rows = rows.join(lead.select("query_id", "collection"), ["query_id", "collection"], "left_semi")
    order = {"unified_ranking": [F.desc("score"), "rowid"], "interleave": ["rank_in_collection", "collection"], "group_by_collection": ["collection", "rank_in_collection"]}
    if how not in order:
        raise ValueError(f"unknown merge {how!r}")
    w = Window.partitionBy("query_id").orderBy(*order[how])
    rows = rows.withColumn("position", F.row_number().over(w))
    return rows if how == "group_by_collection" else rows.where(F.col("position") <= limit)
