"""The pipeline's stages one by one against plain Python, and the whole run."""

import collections
import re

import corpus_pipeline as P
import pytest
from quarry.llm import mixing, secrets
from quarry.llm.common import settle

from .test_dedup import brute


def test_stages(spark, docs, rows, sf_dir, tmp_path):
    base = rows[3][1].split()
    spark.createDataFrame([(1, " ".join(base[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "secrets", "mix"]
    one = settle(step["language_id"](spark, docs, str(tmp_path)), "t1")
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert one.columns == docs.columns and one.count() == len(left)
    two = settle(step["near_dedup"](spark, one, str(tmp_path)), "t2")
    kept = set(brute(left).values())
    assert {r.doc_id for r in two.collect()} == kept | {None} and two.columns == docs.columns
    three = settle(step["decontaminate"](spark, two, str(tmp_path)), "t3")
    gone = {r[0] for r in rows if r[1] and " ".join(base[:10]) in r[1]}
    assert {r.doc_id for r in three.collect()} == {x for x in kept | {None} if x not in gone}
    four = settle(step["secrets"](spark, three, str(tmp_path)), "t4")
    assert four.columns == docs.columns and four.count() == three.count() and secrets.scan(four).where("is_secret").count() == 0
    five = step["mix"](spark, four, str(tmp_path))
    assert five.count() == four.count()


def test_run(spark, sf_dir):
    """The whole run over the whole table against plain Python: which documents stay, their sizes, and the targets."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9)) if w}
    left = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    first = {i for i, c in brute(left).items() if i == c}
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + k]) in windows for w in [words(t)] for i in range(len(w)) for k in sizes)
    want = {i: s for i, t, s in left if i in first and not hit(t)}
    assert 0 < len(want) < len(left) < len(docs) or len(want) < len(docs)
    out = P.run(spark, sf_dir).collect()
    assert {r.doc_id: r.source for r in out} == want and len(out) == len(want)
    text = {i: t for i, t, _ in docs}
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(0 < r.size <= n(text[r.doc_id]) for r in out) and sum(r.size == n(text[r.doc_id]) for r in out) > 0.5 * len(out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sum(r.size for r in by[s]) for s in names], [[5.0, 2.0, 1.0][i % 3] for i in range(len(names))])
    for s, g in zip(names, goal):
        assert abs(sum(r.taken for r in by[s]) - g) <= 1 and all(r.target == pytest.approx(g) and r.taken <= 3 * r.size for r in by[s])


def test_run_of_empty_tables(spark, sf_dir, tmp_path):
    for x in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{x}.parquet").limit(0).write.parquet(str(tmp_path / f"{x}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, no_docs, sf_dir, k):
    assert P.STAGES[k][1](spark, no_docs, sf_dir).count() == 0
