"""Near-duplicates and repeated substrings against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import minhash, repeats


def shingles(text, count=False):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return frozenset()
    s = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    if count:
        seen = {}
        return frozenset((x, seen.setdefault(x, itertools.count()).__next__()) for x in s)
    return frozenset(s)


def brute(rows, count=False):
    """Class of each doc_id: components of equal texts and of similar ones."""
    have = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0])
    sets = {i: shingles(t, count) for i, t in have}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if (not sets[a] and not sets[b]) or (n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_classes_of_a_whole_table(spark, sf_dir):
    """The registered query against all pairs: every pair of similarity 0.8 or more is linked, and no other."""
    from quarry.llm import queries as Q

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert len(set(want.values())) < len(rows)
    assert {r.doc_id: r.class_id for r in Q.op1_dart_minhash(spark, sf_dir).collect()} == want


def test_copies_that_repeat_a_passage(spark):
    """Far apart by counted shingles, equal as sets: the set's signature links them."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base * 40)), (3, " ".join(base * 40 + ["end"])), (4, " ".join(f"v{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classes(df).collect()} == brute(rows) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.class_id for r in minhash.classes(df, weighting="count").collect()} == brute(rows, True) == {1: 1, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize("weighting", ["both", "set", "count"])
def test_classes(docs, rows, weighting):
    got = minhash.classes(docs, weighting=weighting)
    assert got.count() == len(rows)
    want = brute(rows, weighting == "count")
    for r in got.collect():
        assert r.class_id == (0 if r.doc_id is None else want[r.doc_id])


def test_deduplicate(docs, rows, no_docs):
    kept = minhash.deduplicate(docs.withColumns({"__id": F.lit(7), "__ID_": F.lit("x"), "class_id": F.lit(1)})).drop("__id", "__ID_", "class_id")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(brute(rows).values())) and ids.count(None) == 1
    assert minhash.deduplicate(no_docs).count() == 0


def test_parity_maps_differ_by_no_more_than_the_sets(spark):
    r = np.random.Generator(np.random.PCG64(2))
    sets = [sorted({int(x) for x in r.integers(-500, 500, n)}) for n in (1, 30, 200, 400, 400)]
    sets.append([*sets[3][5:], 1001, 1002])
    got = minhash._parity(spark.createDataFrame(list(enumerate(sets)), "v long, s array<int>")).collect()
    maps = {x.v: [x[p] & (2**64 - 1) for p in minhash.MAPS] for x in got}
    for a, b in itertools.combinations(range(len(sets)), 2):
        differ, true = sum((x ^ y).bit_count() for x, y in zip(maps[a], maps[b], strict=True)), len(set(sets[a]) ^ set(sets[b]))
        assert differ <= true and (differ - true) % 2 == 0
    assert sum((x ^ y).bit_count() for x, y in zip(maps[3], maps[5], strict=True)) > 0


def test_several_texts_of_one_document(spark):
    """A short text's link holds beside a long text of the same doc_id."""
    long, short = " ".join(f"l{i}" for i in range(400)), " ".join(f"s{i}" for i in range(60))
    rows = [(1, long), (1, short), (2, short + " more"), (3, long + " more")]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.class_id) for x in got} == {(1, 1), (2, 1), (3, 1)}


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.Generator(np.random.PCG64(1))
    e = r.integers(0, 2**64, 300, np.uint64)
    wa, wb = r.random(300) * 4 + 0.1, r.random(300) * 4 + 0.1
    k = 4000
    sig = minhash.dart_minhash(np.tile(e, 2), np.concatenate((wa, wb)), np.repeat([0, 1], 300), 3, k)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)
    assert (sig[:2] != 0).all() and not sig[2].any()
    alone = minhash.dart_minhash(e, wa, np.zeros(300, np.int64), 1, k)
    assert (alone[0] == sig[0]).all()


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 50 != 49], "a long, b long")
    got = {r.v: r.c for r in minhash.components(edges).collect()}
    assert all(c == v // 50 * 50 for v, c in got.items())


def brute_repeats(rows):
    out, seen = {}, set()
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(b[j : j + 100])
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, rows, no_docs):
    known = docs.where("doc_id is not null")
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in repeats.remove_repeats(known).collect()]
    want = brute_repeats(rows)
    assert len(got) == sum(r[0] is not None for r in rows) and all(want[i] == x for i, x in got)
    assert repeats.remove_repeats(no_docs).count() == 0
    # a null doc_id comes first: then the copies lose everything
    first = {r.doc_id: r for r in repeats.remove_repeats(docs, with_text=True).collect()}
    assert first[None].n_removed == 0 and first[0].n_removed == first[0].n_bytes and first[0].kept == b""


def check_repeats(df, rows, **limits):
    want = brute_repeats(rows)
    got = repeats.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


@pytest.mark.parametrize("hot", [1024, 1])
def test_repeats_within_a_text_and_in_long_stretches(spark, monkeypatch, hot):
    """Also with every shared trigger taken for a hot one, and with small batches and suffix arrays."""
    for name, x in (("PIECE", 700), ("CHUNK", 900), ("BATCH", 40), ("ARRAY", 500), ("HOT", hot)):
        monkeypatch.setattr(repeats, name, x)
    a = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(900))
    rows = [(1, a + a[50:400] + "zz"), (2, "x" * 350), (3, a[300:420] + "q" + a[:99]), (4, "ab" * 200)]
    rows += [(10 + i, f"{i * 7919 % 1000:03d}" * (i % 9) + a[100 + i : 260 + 2 * i] + f"{i}" * 60) for i in range(60)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_repeats_of_a_whole_table(spark, sf_dir):
    """The registered query against brute force."""
    from quarry.llm import queries as Q

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_repeats(rows)
    got = Q.op6_suffix_dedup(spark, sf_dir).collect()
    assert len(got) == len(rows) and sum(r.n_removed > 0 for r in got) > 10
    for r in got:
        assert want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


def test_suffix_classes_are_those_of_sorted_suffixes():
    r = np.random.Generator(np.random.PCG64(3))
    for size in (0, 5, 700):
        x = r.integers(0, 2, size, np.uint8)
        x[size // 2 :] = x[: size - size // 2]
        b = x.tobytes() + bytes(40)
        cut = [b[i : i + 37] for i in range(size)]
        order = {c: i for i, c in enumerate(sorted(set(cut) | {bytes(37)}))}
        rank = repeats.suffix_classes(x, 37)
        assert len(rank) == size and all((rank[i] < rank[j]) == (order[cut[i]] < order[cut[j]]) and (rank[i] == rank[j]) == (cut[i] == cut[j]) for i in range(0, size, 7) for j in range(0, size, 5))
