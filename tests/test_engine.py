"""Storage, queue, text functions, planning, streaming and driver-side helpers."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import cache, text, vectors
from quarry.operators import analytics, assist, queryplan
from quarry.operators import queue as Q
from quarry.plans import events as E
from quarry.sources.store import Engine, check_limit, check_name
from quarry.streaming import analytics as S


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def test_documents(engine, spark):
    meta = '{"b": [1, {"x": null}],  "a": "é"}'
    docs = spark.createDataFrame([("1", "T", "one", meta), (" 2 ", None, "two", None), ("1", "T2", "last wins", meta), ("4", None, None, None), ("5", "t", "c", "[1]"), ("6", "t", "c", '{"collection": "x"}'), ("  ", "t", "c", None)], "id string, title string, content string, metadata string")
    table, rejected = engine.upsert_documents(docs, now=5)
    assert {(r.id, r.content) for r in table.collect()} == {("1", "last wins"), ("2", "two")}
    assert table.where("id = '1'").first().metadata == meta
    assert {r.errors[0] for r in rejected.collect()} == {"content or title is required", "metadata is not an object", "metadata must not name a collection", "id is blank"}
    engine.create_collection("other")
    table, _ = engine.upsert_documents(docs.limit(1), "other", now=9)
    assert table.count() == 3
    table, _ = engine.upsert_documents(docs.limit(1), now=9)
    row = table.where("id = '1' and collection = 'default'").first()
    assert (row.created_at, row.updated_at, row.content) == (5, 9, "one")
    _, rejected = engine.upsert_documents(docs.limit(1), "nowhere")
    assert rejected.first().errors == ["unknown collection"]
    assert engine.delete_documents(spark.createDataFrame([("other", "1")], "collection string, id string")) == 1
    assert {r.name: r.documents for r in engine.collection_info().collect()} == {"default": 2, "other": 0}
    with pytest.raises(ValueError):
        engine.create_collection("other")


def test_a_crash_between_writing_and_publishing_loses_nothing(engine, spark, monkeypatch):
    """The table stays as it was, whatever the writer was stopped at, and a new engine finds it."""
    docs = spark.createDataFrame([("1", "T", "one")], "id string, title string, content string")
    engine.upsert_documents(docs)

    def stop(self, old, new):
        raise KeyboardInterrupt

    monkeypatch.setattr(Engine, "_rename", stop)
    for change in (lambda: engine.upsert_documents(docs.withColumn("id", F.lit("2"))), lambda: engine.write("documents", engine.table("documents").limit(0))):
        with pytest.raises(KeyboardInterrupt):
            change()
        assert Engine(spark, engine.path).table("documents").count() == 1
    monkeypatch.undo()
    # two writers: the slower one fails, and its rows are not half there
    m = engine._manifest("documents")
    engine.upsert_documents(docs.withColumn("id", F.lit("3")))
    with pytest.raises(RuntimeError, match="another writer"):
        engine._publish("documents", m, m)
    assert Engine(spark, engine.path).table("documents").count() == 2


def test_the_index_follows_the_documents(engine, spark):
    from quarry.operators import index

    kind = "id string, title string, content string, collection string"
    first = [("1", "red apples", "sweet red fruit", "default"), ("2", "green pears", "sweet", "default"), ("1", "red cars", "fast", "other")]
    engine.create_collection("other")
    found = lambda q, **o: sorted((r.collection, r.id) for r in engine.search(q, **o).hits.collect())
    engine.upsert_documents(spark.createDataFrame(first, kind))
    assert found("red") == [("default", "1"), ("other", "1")] and found("red", collection="other") == [("other", "1")]
    engine.upsert_documents(spark.createDataFrame([("1", "blue plums", "sour", "default"), ("3", "red wine", "sour red", "default")], kind))
    assert engine._index_is_current() and found("red") == [("default", "3"), ("other", "1")] and found("plums") == [("default", "1")]
    engine.delete_documents(spark.createDataFrame([("other", "1")], "collection string, id string"))
    assert engine._index_is_current() and found("cars") == [] and engine.table("documents").count() == 3
    # the same as an index made anew
    ix, new = engine.index(), index.build(engine.table("documents"), ("title", "content", "metadata"))
    key = ["rowid", "term", "tf", "dl"]
    assert sorted(map(str, ix.postings.select(key).collect())) == sorted(map(str, new.postings.select(key).collect()))
    assert sorted(map(str, ix.frequencies.select("term", "df").collect())) == sorted(map(str, index.frequencies(new.postings).collect()))
    assert engine.verify_documents(spark.createDataFrame([("1",), ("9",)], "id string")).orderBy("id").collect() == [("default", "1", True, True), ("default", "9", False, False)]
    # an index that missed a change is built again
    engine.append("documents", engine.table("documents").where("id = '3'").withColumns({"id": F.lit("4"), "rowid": F.lit(4).cast("long"), "content": F.lit("late zebra")}))
    assert found("zebra") == [("default", "4")]


def test_engine_search(engine, spark):
    rows = [(str(i), f"title {i}", f"common word{i % 3} text {'needle' if i == 5 else ''} 100%") for i in range(12)]
    engine.upsert_documents(spark.createDataFrame(rows, "id string, title string, content string"))
    engine.put_vectors(engine.table("documents").select("rowid", F.array(F.col("id").cast("float"), F.lit(1.0)).alias("embedding")))
    r = engine.search("needle", vector=[5.0, 1.0], limit=3, enable_like=True, rrf_k=10)
    hits = r.hits.orderBy(F.desc("score")).collect()
    assert hits[0].id == "5" and hits[0].score == pytest.approx(1 / 11 + 1 / 11 + 1 / 10) and r.debug["channels"] == ["fts", "vec", "like"] and r.debug["planning_ms"] > 0
    own = engine.search("needle", vector=[5.0, 1.0], limit=3, method="custom", custom=lambda fs, fr, d, vr, lr: F.coalesce(-d, F.lit(-99.0))).hits.orderBy(F.desc("score")).collect()
    assert [x.id for x in own][0] == "5"
    assert {x.id for x in engine.search_text("title:5", syntax=True).hits.collect()} == {"5"}
    assert engine.search_text("%").debug["skipped"] == "too_short" and engine.search_text("needle").hits.first().id == "5"
    assert {x.collection for x in engine.search_global("common").collect()} == {"default"}
    out = engine.search_advanced("common", {"text": [{"field": "content", "op": "contains", "value": "word1"}]}, facets={"c": {"kind": "terms", "field": "collection"}})
    assert out["hits"].count() == 4 and out["c"].first().doc_count == 4
    near = engine.search_semantic("x", vectors.HashProvider(2), 2, threshold=2.0)
    assert near.count() == 2
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            engine.search("x", limit=bad)


def test_changes_by_sql(engine, spark):
    engine.write("users", spark.createDataFrame([(1, "a", 30), (2, "b'c", 40)], "id long, name string, age int"))
    got = engine.execute("INSERT INTO users (id, name) VALUES (?, ?), (4, 'x, y') RETURNING id, upper(name) AS n", [3, "c"])
    assert got.rows_modified == 2 and sorted(tuple(r) for r in got.returned.collect()) == [(3, "C"), (4, "X, Y")]
    assert engine.execute("INSERT INTO users SELECT id + 10, name, age FROM users WHERE age IS NOT NULL").rows_modified == 2
    up = engine.execute("UPDATE users SET age = coalesce(age, 0) + ?, name = concat(name, ',(') WHERE id >= ? RETURNING *", [5, 4])
    assert up.rows_modified == 3 and {r.age for r in up.returned.collect()} == {5, 35, 45} and {r.name[-2:] for r in up.returned.collect()} == {",("}
    assert engine.execute("delete from users where age > :a", {"a": 40}).rows_modified == 1
    assert engine.sql("select count(*) n, sum(age) s from users").first() == (5, 30 + 40 + 5 + 35)
    assert engine.execute("DELETE FROM users").rows_modified == 5 and engine.table("users").count() == 0
    for bad in ("DROP TABLE users", "UPDATE documents SET title = 'x'", "UPDATE users SET nope = 1"):
        with pytest.raises(ValueError):
            engine.execute(bad)


def test_sql_and_statements(engine, spark):
    engine.bulk_insert("users", [{"id": 1, "age": 30}, {"id": 2, "age": 40}])
    engine.add_column("users", "mail", "string")
    assert engine.bulk_insert("users", [{"id": 3, "mail": "x"}]) == 1
    assert engine.sql("select count(*) n from users where age > :a", {"a": 35}).first().n == 1
    st = engine.prepare("select id from users where id >= ? order by id")
    st.bind([2])
    assert st.step() and st.get() == [2] and st.columns() == ["id"]
    assert st.step() and st.as_dict() == {"id": 3} and not st.step()
    st.reset()
    assert [r["id"] for r in st] == [2, 3]
    engine.register_function("twice", lambda s: s * 2, "long")
    assert engine.sql("select twice(id) t from users where id = 2").first().t == 4
    for bad in ("", None):
        with pytest.raises(ValueError):
            engine.sql(bad)
    engine.drop("users")
    with pytest.raises(ValueError):
        engine.table("users")


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_snapshot(engine, spark, tmp_path, kind):
    engine.upsert_documents(spark.createDataFrame([("1", "t", "c", "{}")], "id string, title string, content string, metadata string"))
    engine.put_vectors(spark.createDataFrame([(1, [1.0, 2.0])], "rowid long, embedding array<float>"), 2)
    with pytest.raises(ValueError):
        engine.put_vectors(spark.createDataFrame([(2, [1.0])], "rowid long, embedding array<float>"), 2)
    engine.snapshot(str(tmp_path / "snap"), kind)
    other = Engine(spark, str(tmp_path / "db2"))
    other.restore(str(tmp_path / "snap"))
    assert other.stats() == engine.stats()
    with pytest.raises(ValueError):
        other.restore(str(tmp_path / "snap"))
    other.restore(str(tmp_path / "snap"), overwrite=True)
    other.clear()
    assert other.table("documents").count() == 0


def test_embeddings(engine, spark):
    engine.upsert_documents(spark.createDataFrame([(str(i), "t", f"c{i}", None) for i in range(4)], "id string, title string, content string, metadata string"))
    assert engine.regenerate_embeddings(vectors.HashProvider(8)) == 4
    assert engine.regenerate_embeddings(vectors.HashProvider(8)) == 0
    assert engine.embedding_status().first().ready
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x")], "id string, text string")
    first = vectors.embed_missing(a, spark.createDataFrame([], "key string, embedding array<float>"), vectors.HashProvider(8))
    assert first.where("cached").count() == 0 and first.count() == 3
    again = vectors.embed_missing(a, first, vectors.HashProvider(8))
    assert again.where("cached").count() == 3


def test_queue(spark):
    empty = spark.createDataFrame([], Q.SCHEMA)
    names = spark.createDataFrame([("default",), ("b",)], "name string")
    items = spark.createDataFrame([("default", str(i), f"t{i}", 1 + i % 2) for i in range(5)] + [("b", "9", "x", 1), ("zz", "1", "x", 1)], "collection_name string, document_id string, text_content string, priority int")
    q, rejected = Q.enqueue(empty, items, 100, names)
    assert q.count() == 6 and rejected.count() == 1
    assert Q.enqueue(q, items, 101, names, dedupe=True)[0].count() == 6
    assert [r.priority for r in Q.claim(q, 2).collect()] == [2, 2]
    docs = spark.createDataFrame([("default", str(i), i) for i in range(4)], "collection string, id string, rowid long")
    p = Q.process(q, docs, vectors.HashProvider(4), 200, batch=2, max_retries=1, collection="default")
    assert (p.processed, p.failed, p.remaining) == (2, 0, 3)
    p2 = Q.process(p.queue, docs, vectors.HashProvider(4), 300, batch=9, max_retries=1, collection="default")
    assert (p2.processed, p2.failed, p2.remaining) == (3, 1, 0) and p2.vectors.count() == 2
    by = {r.collection_name: r for r in Q.status(p2.queue).collect()}
    assert (by["default"].completed, by["default"].failed, by["b"].pending, by["*"].total) == (4, 1, 1, 6)
    assert Q.clear(p2.queue, "default", "completed")[1] == 4 and Q.clear(p2.queue)[0].count() == 0


def test_text(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("x")).first().x
    assert one(text.strip_html, "<b>a</b>&amp;lt;&copy;&zzz;b") == " a &lt;© b"
    assert one(text.strip_markdown, "# H\n**b** _i_ ~~s~~ `c`\n- x\n1. y\n> q\n---\n|t|") == " H\nb i s c\nx\ny\nq\n\n"
    assert one(lambda c: text.truncate(c, 12), "hello brave new world") == "hello brave"
    assert one(lambda c: text.truncate(c, 10, strategy="middle", whole_words=False, indicator=".."), "abcdefghijklmnop") == "abcd..mnop"
    for s, h in (("", 0), ("abc", 96354), ("Привет мир", None), ("hello world, a long text", None)):
        want = 0
        for b in [s.encode("utf-16-be")[i : i + 2] for i in range(0, 2 * len(s), 2)]:
            want = (want * 31 + int.from_bytes(b, "big") + 2**31) % 2**32 - 2**31
        assert one(text.java_hash, s) == want and (h is None or h == want)
    p = one(text.process, "")
    assert p.error == "text is empty" and p.text is None
    p = one(text.process, "<p>" + "word " * 3000 + "</p>")
    assert p.was_truncated and p.processed_length <= 8192 and p.operations[-1] == "truncate"
    assert one(text.mask_pii, "a@b.com 1234-5678-9012-3456 123-45-6789") == "[EMAIL] [CARD] [SSN]"
    assert one(text.device_type, "Mozilla iPhone Mobile") == "mobile"
    assert text.escape_like("5%_\\") == "5\\%\\_\\\\"
    assert one(lambda c: text.tokens(c, True), "Déjà-vu №5") == ["deja", "vu", "5"]


@pytest.mark.parametrize(
    ("query", "kind", "strategy"),
    [
        ("database", "short_keyword", "exact_match"), ("database search", "short_keyword", "keyword"), ('"exact phrase" here', "exact_phrase", "exact_match"), ("cats and dogs", "boolean_query", "boolean"),
        ("how does it work", "question", "semantic"), ("top 10", "numeric", "exact_match"), ("a b c d e f g h", "long_phrase", "semantic"), ("Русский запрос", "short_keyword", "exact_match"),
    ],
)
def test_planning(spark, query, kind, strategy):
    df = spark.createDataFrame([(1, query)], "query_id long, query string")
    r = queryplan.plan(queryplan.analyze(df, queryplan.Context(has_embeddings=True)), queryplan.Context(has_embeddings=True)).first()
    assert (r.query_type, r.strategy) == (kind, strategy)
    assert 0 <= r.confidence <= 1 and r.plan.limit == 20


def test_entities_and_expansion(spark):
    df = spark.createDataFrame([("find John Smith at NASA on 2024-01-05",)], "q string")
    found = df.select(queryplan.entities(F.col("q")).alias("e"), queryplan.expansion(F.col("q")).alias("x")).first()
    q = "find John Smith at NASA on 2024-01-05"
    assert {(e.type, e.text) for e in found.e} >= {("PERSON", "John Smith"), ("ORGANIZATION", "NASA"), ("DATE", "2024-01-05")}
    assert all(q[e.start : e.end] == e.text for e in found.e)
    assert (found.x.expanded[-1], found.x.confidence) == ("search", 0.6)
    one = lambda q, c=None: spark.range(1).select(queryplan.expansion(F.lit(q), c).alias("x"), queryplan.linguistics(F.lit(q)).alias("l")).first()
    r = one("find good", F.array(F.lit("find fine restaurants nearby today"))).x
    assert (r.expanded, r.confidence, r.concepts) == (["find", "good", "search", "excellent", "fine"], 0.85, ["fine", "restaurants", "nearby"])
    assert [(x.language, x.language_confidence) for x in (one("Find it, now!").l, one("naïve find").l, one("find кот").l)] == [("en", 0.8), ("unknown", 0.5), ("ru", 0.8)]


def test_stream_equals_batch(spark, sf_dir):
    got = S.run_once(spark, sf_dir, lambda df: S.tumbling(E.to_log(df), "1 day", "1 day"), "complete")
    log = E.log(spark, sf_dir)
    q = F.col("event_type") == "query"
    want = log.groupBy(F.window("ts", "1 day")["start"].alias("bucket")).agg(F.count_if(q).alias("queries"))
    assert sorted(map(str, got.select("bucket", "queries").collect())) == sorted(map(str, want.collect()))


def test_session_state_stream(spark, sf_dir):
    got = S.run_once(spark, sf_dir, lambda df: S.session_state(E.to_log(df)), "update")
    want = E.log(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("event_type") == "query").alias("queries"))
    assert sorted(map(str, got.select("session_id", "queries").collect())) == sorted(map(str, want.collect()))


def test_analytics_edges(spark, sf_dir):
    log = E.log(spark, sf_dir)
    empty = analytics.behavior(log.limit(0)).first()
    assert empty.sessions == 0 and empty.click_rate == 0.0
    assert analytics.performance(log.limit(0)).first().total_queries == 0
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert analytics.index_percentiles(df, "v", {"p50": 0.5, "p99": 0.99}).first().asDict() == {"p50": 5.0, "p99": 9.0}


def test_smoothing_is_the_fold(spark, sf_dir):
    x = E.log(spark, sf_dir).where("event_type = 'performance'").orderBy("ts", "query_id").collect()
    want = {}
    for r in x:
        want[r.strategy] = 0.1 * r.search_time + 0.9 * want.get(r.strategy, 0.0)
    got = {r.strategy: r.smoothed for r in analytics.smoothed(E.log(spark, sf_dir)).collect()}
    assert got == pytest.approx(want)


def test_cache():
    now = [0.0]
    c = cache.Cache(max_entries=5, strategy="lru", clock=lambda: now[0])
    for i in range(5):
        now[0] += 1
        c.set(f"k{i}", i, tags=("even",) if i % 2 == 0 else ())
    c.get("k0")
    now[0] += 1
    c.set("k5", 5)
    assert "k1" not in c.entries and "k0" in c.entries and len(c.entries) <= 5
    assert c.invalidate("tag:even") >= 1
    now[0] += 1000
    assert c.get("k5") is None


def test_assist():
    calls = []

    def f(prompt, **_):
        calls.append(prompt)
        if len(calls) == 1:
            raise assist.ProviderError("busy", retryable=True)
        return 'ok {"enhanced": "better", "suggestions": ["a"]}' if "Improve" in prompt else '{"summary": "s"}'

    p = assist.CallableProvider(f)
    out = assist.search_with_text_model(p, "q", lambda q: [q], lambda h: [{"title": h[0], "content": "x" * 999}], sleep=lambda s: None)
    assert out.hits == ["better"] and out.summary["summary"] == "s" and len(calls) == 3
    assert [assist.delay(i) for i in (1, 2, 9)] == [1, 2, 30]
    with pytest.raises(ValueError):
        assist.call(p, "")
    with pytest.raises(assist.ProviderError):
        assist.call(assist.CallableProvider(lambda *_: (_ for _ in ()).throw(assist.ProviderError("no"))), "x")


def test_names():
    assert check_name("a-b_1") == "a-b_1" and check_limit(10) == 10
    for bad in ("", "a b", "x" * 65):
        with pytest.raises(ValueError):
            check_name(bad)
    for bad in (0, 10_001, True, "1"):
        with pytest.raises(ValueError):
            check_limit(bad)


def test_smoothing_forgets_nothing(spark):
    """A small alpha weighs thousands of events."""
    rows = [("performance", 1_700_000_000 + 60 * i, "s", "q", f"q{i % 7}", 100.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_type string, t long, strategy string, query string, query_id string, search_time double").withColumn("ts", F.timestamp_seconds("t"))
    assert analytics.smoothed(df, 0.001).first().smoothed == pytest.approx(100 * (1 - 0.999**3000))


def test_entry_without_the_training_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for x in ("quarry/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / x, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(set(e.oracle_sql()) <= set(q), 'hybrid_rrf3' in q, any(n.startswith('op') for n in q))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "r")}
    for _ in range(2):
        got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
        assert got.stdout.split() == ["True", "True", "False"], got.stderr
        (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_savepoints_and_transactions(engine, spark):
    one = spark.createDataFrame([("1", "T", "apples")], "id string, title string, content string")
    engine.upsert_documents(one)
    engine.index()
    engine.savepoint("a")
    for i in range(4):  # more versions than are kept otherwise
        engine.upsert_documents(one.withColumns({"id": F.lit(str(i)), "content": F.lit(f"pears {i}")}))
    engine.write("extra", one)
    engine.rollback_to("a")
    assert [r.content for r in engine.table("documents").collect()] == ["apples"] and "extra" not in engine.tables()
    assert engine._index_is_current() and engine.search("apples").hits.count() == 1 and engine.search("pears").hits.count() == 0
    engine.release("a")
    with pytest.raises(ValueError):
        engine.rollback_to("a")

    def fails(e):
        e.upsert_documents(one.withColumn("id", F.lit("9")))
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        engine.transaction(fails)
    assert engine.table("documents").count() == 1
    engine.transaction(lambda e: e.upsert_documents(one.withColumn("id", F.lit("9"))))
    told = []
    assert engine.insert_batches(iter([one.withColumn("id", F.lit(x)) for x in "xy"] + [one.withColumn("id", F.lit(" "))]), progress=lambda *a: told.append(a)) == 1
    assert engine.table("documents").count() == 4 and told == [(1, 1), (2, 2), (3, 3)]
    assert ("id", "string", True) in engine.pragma("table_info(documents)") and "documents" in engine.pragma("table_list")
    with pytest.raises(ValueError):
        engine.pragma("journal_mode")


def test_guards_and_errors():
    from quarry.functions import guards

    good = {"open": {"filename": "x"}, "execute": {"sql": "select ?", "params": [1, None, b"x", [1.0]]}, "bulk_insert": {"table": "t", "rows": [{}]}, "search": {"vector": [0.5]}, "create_collection": {"name": "c", "dimensions": 3}}
    assert all(guards.check(k, v) is v for k, v in good.items())
    for k, v in {"open": {}, "execute": {"sql": 1}, "bulk_insert": {"table": "t", "rows": [1]}, "search": {"limit": 3}, "enqueue": {"collection": "c"}, "select": [], "clear_queue": {"status": 1}}.items():
        with pytest.raises(ValueError):
            guards.check(k, v)
    assert guards.is_identifier("a_1") and not guards.is_identifier("1a") and not guards.is_json(float("nan")) and not guards.is_document_id(" ") and not guards.is_number(True)
    kinds = [guards.classify(e) for e in (TimeoutError("x"), RuntimeError("table t was changed by another writer"), ValueError("bad limit"), MemoryError("out of memory"), RuntimeError("odd"))]
    assert [(k.severity, k.recoverable) for k in kinds] == [("medium", True), ("medium", True), ("low", False), ("critical", False), ("medium", False)]


def test_providers_and_settings(spark):
    from quarry.functions import settings

    calls, naps = [], []

    def client(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionError("reset")
        return [[1.0, 2.0] for _ in texts]

    p = vectors.RemoteProvider(client, 2, retries=1, per_second=1e9, sleep=naps.append)
    assert p.embed(["a", "b"]) == [[1.0, 2.0]] * 2 and naps == [1.0] and (p.metrics["embeddings"], p.metrics["errors"]) == (2, 1)
    slow = vectors.RemoteProvider(lambda t: __import__("time").sleep(0.5), 2, timeout=0.05, retries=0, fallback=vectors.HashProvider(2))
    assert len(slow.embed(["x"])[0]) == 2 and slow.metrics["fallbacks"] == 1
    with pytest.raises(ValueError):
        vectors.RemoteProvider(lambda t: [[1.0]], 2, retries=0).embed(["x"])
    now = [0.0]
    r = vectors.Registry(10, lambda: now[0])
    r.register("h", lambda: vectors.HashProvider(4), preload=True)
    assert r.get("h").dimensions == 4 and r.most_used() == ["h"]
    now[0] = 11
    assert r.evict() == ["h"] and r.most_used() == []
    c = settings.collection_config("remote", 64, preprocessing={"lower_case": True}, tags=["a"])
    assert c["preprocessing"]["lower_case"] and c["preprocessing"]["strip_html"] and c["batch_size"] == 100 and settings.vector_table_name("c", 64) == "vec_c_64d"
    assert settings.merge_configs({"a": {"b": [1, 2]}, "c": 1}, {"a": {"b": [3]}, "c": None}) == {"a": {"b": [3]}, "c": 1}
    one = spark.range(1).select(vectors.random_embedding(F.lit(7), 50).alias("v"), text.djb_hash(F.lit("Привет, a longer text")).alias("h"), text.zero_blob(F.lit(3)).alias("z"), text.random_blob(F.lit(40), F.lit(5)).alias("b"), text.safe_json(F.lit("{x"), "a int", F.struct(F.lit(9).alias("a"))).alias("j")).first()
    assert all(-1 <= x < 1 for x in one.v) and len(set(one.v)) == 50 and bytes(one.z) == b"\0\0\0" and len(one.b) == 40 and one.j.a == 9
    h = 5381
    for ch in "Привет, a longer text":
        h = ((((h + 2**31) % 2**32 - 2**31) * 32 + 2**31) % 2**32 - 2**31) + h + ord(ch)
    assert one.h == format(abs(h), "x")


def test_planning_of_long_queries(spark):
    """Keywords and entities of a text of 20 000 words, by plain Python and in seconds: no word reads the whole text again."""
    ws = [f"word{i % 7001}" if i % 10 else str(i) for i in range(20_000)]
    q = " ".join(ws)
    c = F.col("q")
    began = time.monotonic()
    r = spark.createDataFrame([(q,)], "q string").select(queryplan.keywords(c).alias("k"), queryplan.entities(c).alias("e"), queryplan.count_entities(c).alias("n"), queryplan.expansion(c)["confidence"].alias("x")).first()
    assert time.monotonic() - began < 30
    counts = Counter(w for w in ws if len(w) > 2)
    want = sorted((-n / len(ws) * (1.2 if q.startswith(w) else 1.0), w) for w, n in counts.items())[:10]
    assert [(-k.weight, k.word) for k in r.k] == want
    assert [(e.text, e.start, e.end) for e in r.e] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\b\d+(?:\.\d+)?\b", q)] and r.n == len(r.e) == 2000


def test_hash_embedding_values(spark):
    """Each token adds its sign to its slot; then length 1."""
    words = "the quick brown fox the end".split()
    slots = spark.createDataFrame([(w,) for w in words], "t string").select(F.pmod(F.xxhash64("t"), F.lit(8)).alias("i"), F.pmod(F.xxhash64("t", F.lit(1)), F.lit(2)).alias("s")).collect()
    want = [0.0] * 8
    for r in slots:
        want[r.i] += 1.0 if r.s == 0 else -1.0
    norm = sum(x * x for x in want) ** 0.5
    got = spark.createDataFrame([("The quick, brown fox. THE end",)], "s string").select(vectors.hash_embedding(F.col("s"), 8).alias("v")).first().v
    assert got == pytest.approx([x / norm for x in want], abs=1e-6)


def test_hash_embedding_of_tokens_that_cancel(spark):
    """Signs that cancel in every place do not make a text one without tokens."""
    got = spark.createDataFrame([(t,) for t in ("Lesenreréch éch est èreè.", "", "?!", None)], "s string").select(vectors.hash_embedding(F.col("s"), 16).alias("v")).collect()
    assert sum(x * x for x in got[0].v) == pytest.approx(1.0, abs=1e-6) and all(not any(r.v) and len(r.v) == 16 for r in got[1:])
    one = spark.range(400).select(vectors.hash_embedding(F.concat(F.lit("a "), F.col("id")), 1).alias("v")).distinct().collect()
    assert {abs(r.v[0]) for r in one} == {1.0}


def test_level_cache(spark, tmp_path):
    now = [0.0]
    make = lambda: cache.LevelCache(spark, str(tmp_path / "c"), lambda: now[0])
    a = make()
    a.set("k", {"x": 1})
    assert a.get("k") == {"x": 1} and a.flush() == 1
    now[0] = 1000  # the first level has forgotten, the second moves it up
    assert a.get("k") == {"x": 1} and a.found == [1, 1, 0] and a.levels[0].get("k") == {"x": 1}
    b = make()
    assert b.get("k") == {"x": 1} and b.found == [0, 0, 1] and b.get("none") is None and b.stats()["hit_rate"] == 0.5
    now[0] = 700_000
    assert make().get("k") is None


def test_histories_and_counters(spark):
    rows = [(i // 100, i, f"q{i}", float(i)) for i in range(230)]
    df = spark.createDataFrame(rows, "user_id long, ts long, query_id string, score double").withColumn("id", F.col("ts"))
    assert analytics.latest(df, "context", ["user_id"]).groupBy("user_id").count().where("count != 10").isEmpty() and analytics.latest(df, "optimizer").agg(F.min("ts")).first()[0] == 130
    assert analytics.top_scores(df.withColumn("query_id", F.lit("q")), 3).first().scores == [229.0, 228.0, 227.0]
    assert spark.range(1).select(analytics.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")), most=2).alias("x")).first().x == ["b", "a"]
    # errors by minute, one forgotten a minute: against the plain loop
    errors = {0: 3, 1: 1, 5: 2, 6: 4, 20: 1, 22: 2}
    log = [("error", 60 * m + i) for m, n in errors.items() for i in range(n)] + [("query", 60 * 24 + 5), ("query", 60 * 23)]
    e = spark.createDataFrame(log, "event_type string, t long").select("event_type", F.timestamp_seconds("t").alias("ts"), F.lit(1.0).alias("search_time"))
    count = 0
    for m in range(24):
        count = max(0, count + errors.get(m, 0) - 1)
    got = analytics.realtime(e, "1970-01-01 00:24:30").first()
    assert (got.recent_errors, got.last_queries) == (count, 1)


def test_scripts_are_restricted():
    from quarry.operators import filters

    assert filters.script("lower(title) = :t AND score >= :s", {"t": "it's", "s": -1}) == "lower(title) = 'it\\'s' AND score >= (-1)"
    for bad in ("reflect('java.lang.System', 'exit', 1)", "java_method('a', 'b')", "id IN (SELECT 1)", "1 = 1; drop table x", "a -- b", "x /* */", "title = :missing"):
        with pytest.raises(ValueError):
            filters.script(bad, {})


def test_stream_participants_are_exact(spark, sf_dir):
    got = S.run_once(spark, sf_dir, lambda df: S.participants(E.to_log(df)), "complete")
    want = E.log(spark, sf_dir).where("event_type = 'experiment'").groupBy("experiment_id", "variant").agg(F.count_distinct("session_id").alias("participants"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    prefs = S.run_once(spark, sf_dir, lambda df: S.profiles(E.to_log(df)), "complete")
    assert prefs.where("preference = 'query'").count() > 0 and prefs.where("weight > 1").count() == 0
