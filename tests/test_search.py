"""Retrieval rules on small corpora."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import filters, index, match, rerank, results, search

DOCS = [
    (1, "Machine learning basics", "Introduction to machine learning and data", "default", "{}"),
    (2, "Search 100% engine_x", "Full text search engines use inverted indexes", "default", '{"k": 1, "type": "a"}'),
    (3, "Кошки", "Документ про кошек и собак, Привет мир", "ru", '{"k": 2}'),
    (4, "Vectors", "Vector search finds nearest neighbours in machine space", "default", None),
    (5, None, "the learning machine", "other", '{"d": "2024-01-05"}'),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "rowid long, title string, content string, collection string, metadata string").cache()


@pytest.fixture(scope="module")
def ix(docs):
    return index.build(docs)


def ids(df):
    return sorted(r.rowid for r in df.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("machine learning", [1, 5]), ("machine OR vector", [1, 4, 5]), ('"machine learning"', [1]), ("learn*", [1, 5]), ("machine NOT learning", [4]), ("title:machine", [1]),
        ("^vectors", [4]), ("NEAR(search neighbours, 3)", [4]), ("(search AND text) OR кошки", [2, 3]), ("привет", [3]), ("'); DROP TABLE x", []), ("", []), ("zzz", []),
    ],
)
def test_query_syntax(ix, query, want):
    assert ids(search.fts(ix, query)) == want


def test_bm25_modes_and_batch(spark, ix):
    q = spark.createDataFrame([(1, "machine learning"), (2, "search engines")], "query_id long, text string")
    either, every = search.bm25(ix, q), search.bm25(ix, q, "and")
    assert {(r.query_id, r.rowid) for r in either.collect()} == {(1, 1), (1, 4), (1, 5), (2, 2), (2, 4)}
    assert {(r.query_id, r.rowid) for r in every.collect()} == {(1, 1), (1, 5), (2, 2)}
    alone = search.bm25(ix, q.where("query_id = 1"))
    assert sorted(map(str, either.where("query_id = 1").collect())) == sorted(map(str, alone.collect()))
    assert all(r.fts_score <= 0 for r in either.collect())


def test_index_merge_has_no_orphans(spark, docs, ix):
    changed = spark.createDataFrame([(1, "New", "other words", "default", "{}")], docs.schema)
    merged = index.merge(ix, changed, docs.where("rowid = 2").select("rowid"))
    want = index.build(changed.unionByName(docs.where("rowid not in (1, 2)")))
    key = ["rowid", "term", "tf"]
    assert sorted(map(str, merged.postings.select(key).collect())) == sorted(map(str, want.postings.select(key).collect()))
    assert merged.lengths.count() == 4


@pytest.mark.parametrize(("text", "why"), [("", "too_short"), ("ab", "too_short"), ("  a ", "too_short"), ("the", "stop_word"), ("WHICH", "stop_word"), ("abc", None), ("привет", None)])
def test_like_guards(text, why):
    assert search.like_skip_reason(text) == why


@pytest.mark.parametrize(("text", "want"), [("100%", [2]), ("e_x", [2]), ("%%%", []), ("MACHINE", [1, 4, 5]), ("ошк", [3]), ("ПРИВЕТ", []), ("Привет", [3]), ("' OR 1=1", [])])
def test_like_is_literal(spark, docs, text, want):
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    assert ids(search.like(docs, q)) == want


def test_like_by_one_and_by_many(spark, docs, monkeypatch):
    """One by one and by the automaton, the same; nulls and empty texts match nothing."""
    more = docs.unionByName(spark.createDataFrame([(9, None, None, "d", None), (10, "", "machine machine", "d", None)], docs.schema))
    q = spark.createDataFrame([(1, "machine"), (2, "machine"), (3, "MACH"), (4, "search"), (5, "ине"), (6, "100% e")], "query_id long, text string")
    one = sorted(map(str, search.like(more, q).collect()))
    monkeypatch.setattr(search, "FEW_NEEDLES", 0)
    assert one == sorted(map(str, search.like(more, q).collect())) and len(one) > 10
    assert search.like(more, q.limit(0)).count() == 0


def test_bucket_on_the_driver(spark):
    words = ["", "a", "машина", "découverte", "x" * 100, "🙂"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r.b for r in df.select(index.bucket(F.col("t"), 16).alias("b")).collect()] == [index.bucket_of(w, 16) for w in words]


def test_knn_blocks_against_all_pairs(spark, monkeypatch):
    """Many items with ties, in small blocks, for each metric."""
    import numpy as np

    from quarry.functions import vectors

    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = np.random.Generator(np.random.PCG64(4))
    x = np.round(r.normal(size=(150, 5)), 1)
    x[100:140] = x[:40]
    items = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "rowid long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, [float(y) for y in x[i]]) for i in range(0, 30, 3)], "query_id long, vector array<double>")
    x = x.astype(np.float32).astype(np.float64)
    for metric, f in (("l2", lambda a, b: np.sqrt(((a - b) ** 2).sum())), ("l1", lambda a, b: np.abs(a - b).sum()), ("dot", lambda a, b: -(a * b).sum())):
        got = {(z.query_id, z.rowid) for z in search.knn(items, q, 6, metric).collect()}
        asked = {z.query_id: np.array(z.vector) for z in q.collect()}
        want = {(i, j) for i, v in asked.items() for _, j in sorted((round(float(f(x[j], v)), 9) + 0.0, j) for j in range(len(x)))[:6]}
        assert got == want


def test_like_order(spark, docs):
    q = spark.createDataFrame([(1, "machine")], "query_id long, text string")
    assert [r.rowid for r in search.like(docs, q).orderBy("like_rank").collect()] == [1, 4, 5]


def test_weights():
    with pytest.raises(ValueError):
        search.Weights(0.5, 0.5, 0.5).check()
    search.Weights(0.501, 0.3, 0.2).check()
    search.Weights(0.9, 0.9).check()


def test_fusion_rules(spark, docs, ix):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "rowid long, embedding array<float>")
    q = spark.createDataFrame([(1, "machine", [1.0, 1.0]), (2, "search", [5.0, 1.0])], "query_id long, text string, vector array<float>")
    r = search.search(docs, ix, items, q, 3, "rrf", enable_like=True)
    assert r.debug["channels"] == ["fts", "vec", "like"]
    assert all(0 < x.score <= 3 / 60 for x in r.hits.collect())
    for one in (1, 2):
        alone = search.search(docs, ix, items, q.where(F.col("query_id") == one), 3, "rrf", enable_like=True).hits
        assert sorted(map(str, r.hits.where(F.col("query_id") == one).collect())) == sorted(map(str, alone.collect()))
    with pytest.raises(ValueError):
        search.search(docs, None, None, q)
    with pytest.raises(ValueError):
        search.search(docs, ix, items, q, method="weighted_rrf", weights=search.Weights(0.5, 0.5, 0.5), enable_like=True)


def test_knn_edges(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None)], "rowid long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    assert [(r.rowid, r.distance) for r in search.knn(items, q, 5, "cosine").orderBy("distance").collect()] == [(2, 0.0), (1, 2.0)]
    assert ids(search.knn(items, q, 5, threshold=0.5)) == [2]


def test_filters(docs):
    f = lambda **s: ids(filters.apply(docs, s))
    assert f(metadata={"k": 1}) == [2]
    assert f(numeric_range=[{"field": "k", "min": 1.5}]) == [3]
    assert f(date_range=[{"field": "d", "start": "2024-01-01", "end": "2024-01-31"}]) == [5]
    assert f(exists=["title"]) == [1, 2, 3, 4]
    assert f(missing=["k"]) == [1, 4, 5]
    assert f(text=[{"field": "content", "op": "regex", "value": "^Full"}]) == [2]
    assert f(should=[{"collections": ["ru"]}, {"metadata": {"k": 2}}], minimum_should_match=2) == [3]
    assert f(must_not=[{"collections": ["default"]}]) == [3, 5]
    assert f(script={"source": "rowid > :n and collection = :c", "params": {"n": 1, "c": "default"}}) == [2, 4]
    with pytest.raises(ValueError):
        f(text=[{"field": "title", "op": "like", "value": "x"}])


def test_plan_has_no_cross_product_and_limits_groups_early(spark, docs, ix):
    q = spark.createDataFrame([(1, "machine learning")], "query_id long, text string")
    df = search.top(search.bm25(ix, q), 2, F.col("fts_score"), F.col("rowid"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_parse_tree():
    t = match.parse('a b OR "c d" NOT e')
    assert t.op == "or" and [k.op for k in t.kids] == ["and", "not"]
    assert match.positive_terms(t) == (["a", "b", "c", "d"], [])
    assert match.or_expand("x y") == "x OR y"


def brute_greedy(scores, sets, alpha, beta):
    out, left = [0], list(range(1, len(scores)))
    jac = lambda a, b: len(a & b) / len(a | b)
    while left:
        best = max(left, key=lambda i: (alpha * scores[i] + beta * max(0.0, 1 - sum(jac(sets[i], sets[j]) for j in out) / len(out)), -i))
        out.append(best)
        left.remove(best)
    return out


def test_greedy_is_the_plain_algorithm():
    import random

    r = random.Random(1)
    scores = sorted((r.random() for _ in range(30)), reverse=True)
    sets = [{r.randint(0, 20) for _ in range(8)} for _ in range(30)]
    for a, b in ((0.7, 0.3), (0.6, 0.4)):
        assert [i for i, _ in rerank.greedy(scores, sets, a, b)] == brute_greedy(scores, sets, a, b)
    assert rerank.greedy([], [], 0.7, 0.3) == []


@pytest.mark.parametrize(("name", "alpha", "beta"), [("mmr", 0.7, 0.3), ("mmd", 0.6, 0.4)])
def test_registered_diversification_is_the_plain_algorithm(spark, sf_dir, name, alpha, beta):
    """The whole documents table, each source's full list."""
    import re

    from quarry.plans import retrieval

    by = {}
    for r in retrieval.result_rows(spark, sf_dir).collect():
        by.setdefault(r.query_id, []).append(r)
    got = {}
    for r in retrieval.QUERIES[name][0](spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.position] = r.id
    assert got.keys() == by.keys()
    for q, rows in by.items():
        rows = sorted(rows, key=lambda r: (-r.score, r.id))[:100]
        sets = [set(re.split(r"\s+", f"{r.title or ''} {r.content or ''}".lower())) for r in rows]
        order = brute_greedy([r.score for r in rows], sets, alpha, beta)
        assert [got[q][i + 1] for i in range(len(rows))] == [rows[i].id for i in order]


def test_snippets():
    text = " ".join(f"w{i}" for i in range(40)) + " target " + " ".join(f"x{i}" for i in range(40))
    s = results.py_snippets(text, "target")
    assert len(s) == 1 and "target" in s[0] and s[0].startswith("...") and s[0].endswith("...")
    assert results.py_snippets(text, "absent")[0].endswith("...")
    assert results.py_snippets("", "q") == [""]


def test_result_edges(spark):
    rows = [("q", "alpha words", i, "T" if i % 2 else None, "same content" if i < 2 else f"c{i}", None, 0.5, i) for i in range(4)]
    df = spark.createDataFrame(rows, "query_id string, query string, id long, title string, content string, metadata string, score double, rank int")
    assert {r.normalized_score for r in results.normalize(df).collect()} == {0.0}
    out = results.process(df).collect()
    assert len(out) == 4 and all(0 <= r.final_score <= 1 for r in out) and sorted(r["rank"] for r in out) == [1, 2, 3, 4]
    assert results.process(df.limit(0)).count() == 0


def test_preference_fold(spark):
    rows = [("u", 1, "click", None, True), ("u", 2, "dwell", 6000.0, False), ("u", 3, "skip", None, False), ("u", 4, "dwell", 10.0, False)]
    got = results.preference_update(spark.createDataFrame(rows, "user_id string, ts long, action string, duration double, snippet_used boolean")).first()
    assert (round(got.quality_threshold, 6), round(got.diversity_preference, 6), round(got.snippet_length, 6)) == (0.11, 0.27, 165.0)


def test_result_queries_take_the_operators_own_limit(spark, sf_dir):
    """mmr, mmd and the result chain see up to 100 results of each query, not a cut made before them."""
    from quarry.plans import retrieval

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    sizes = {r.source: min(100, r["count"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").count().collect()}
    assert max(sizes.values()) > 20
    for name in ("mmr", "mmd"):
        got = retrieval.QUERIES[name][0](spark, sf_dir).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in got} == sizes
    whole = results.dedupe(results.normalize(results.quality_filter(retrieval.result_rows(spark, sf_dir), None)))
    assert retrieval.processed(spark, sf_dir).count() == whole.count()
