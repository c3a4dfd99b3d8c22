"""Mixing, media, archives, decontamination, and the registered queries with SQL."""

import base64
import collections
import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, media, mixing, warc
from quarry.llm import queries as Q

from ..compare import assert_same


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    assert_same(Q.QUERIES[name](spark, sf_dir), duck, Q.ORACLE_SQL[name])


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    assert mixing.targets([1, 100, 100], [5, 2, 1]) == [3.0, 132.0, 66.0]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []
    t = mixing.targets([5, 7, 1000, 3], [5, 2, 1, 5])
    assert sum(t) == pytest.approx(1015) and all(x <= 3 * s + 1e-9 for x, s in zip(t, [5, 7, 1000, 3]))


def test_trees_split_exactly():
    t = mixing.deal([1000, 10, 0, 7], 8)
    assert t.sum(1).tolist() == [1000, 10, 0, 7] and (t >= 0).all() and np.ptp(t.sum(0)) <= 3
    assert (t == mixing.deal([1000, 10, 0, 7], 8)).all() and (t != mixing.deal([1000, 10, 0, 7], 8, 5)).any()
    q = mixing.split_quota([400, 10, 0, 2], t)
    assert q.sum(1).tolist() == [400, 10, 0, 2] and (q >= 0).all() and (q <= t).all()
    # a draw without replacement: means and variances are the hypergeometric ones
    many = np.array([mixing.split_quota([400], t[:1], i)[0, 0] for i in range(400)])
    m = t[0, 0]
    mean, var = 400 * m / 1000, 400 * m / 1000 * (1 - m / 1000) * 600 / 999
    assert abs(many.mean() - mean) < 4 * (var / 400) ** 0.5 and 0.7 < many.var() / var < 1.4


def check_mix(mixed, rows, block_words):
    got = mixed.collect()
    assert len(got) == len(rows)
    sums, size = collections.Counter(), collections.Counter()
    for r in got:
        sums[r.source] += r.taken
        size[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws)
    for r in got:
        assert r.source_size == size[r.source] and abs(sums[r.source] - r.target) <= 1
    return sorted(map(str, got))


def test_mix(docs, rows, no_docs):
    words = {str(r[0]): len((r[1] or "").encode().split()) for r in rows}
    one = check_mix(mixing.mix(docs, block_words=500), rows, 500)
    assert one == check_mix(mixing.mix(docs.repartition(7), block_words=500), rows, 500)
    check_mix(mixing.mix(docs), rows, 10**6)
    mixed = mixing.mix(docs, block_words=500, max_broadcast_blocks=0, n_shards=4)
    check_mix(mixed, rows, 500)
    assert all(r.size == words[str(r.doc_id)] for r in mixed.collect())
    each = mixing.shards(mixed).collect()
    assert sum(r.words for r in each) == sum(r.taken for r in mixed.collect()) and {r.shard for r in each} <= set(range(4))
    assert mixing.mix(no_docs).count() == 0


def plain_mix(sized, block_words, n_shards, seed=mixing.SEED):
    """taken by (doc_id, size, u) of rows (doc_id, source, size, u, block order), by plain loops."""
    by = collections.defaultdict(list)
    for r in sized:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in names]
    goal = mixing.targets(sizes, [[5.0, 2.0, 1.0][i % 3] for i in range(len(names))])
    n = [max(1, -(-x // block_words)) for x in sizes]
    words = [min(round(g), 3 * x) for g, x in zip(goal, sizes)]
    whole = [w // x if x else 0 for w, x in zip(words, sizes)]
    rest = [w - k * x for w, k, x in zip(words, whole, sizes)]
    need = [min(k, -(-r * k // x)) if x else 0 for r, k, x in zip(rest, n, sizes)]
    owned = mixing.deal(n, n_shards, seed)
    quota = mixing.split_quota(need, owned, seed)
    out = collections.Counter()
    for i, s in enumerate(names):
        blocks = collections.defaultdict(list)
        for r in by[s]:
            blocks[int(r.u * n[i])].append(r)
        ends = np.cumsum(owned[i])
        lanes = collections.defaultdict(list)
        for b in sorted(blocks, key=lambda b: (blocks[b][0].order[b], b)):
            lanes[int(np.searchsorted(ends, b, side="right"))].append(b)
        line = [b for x in sorted(lanes) for b in lanes[x][: quota[i, x]]] + [b for x in sorted(lanes) for b in lanes[x][quota[i, x] :]]
        left = rest[i]
        for b in line:
            for r in sorted(blocks[b], key=lambda r: (r.u, r.doc_id is not None, r.doc_id, r.size)):
                got = min(left, r.size)
                left -= got
                out[r.doc_id, r.size, whole[i] * r.size + got] += 1
    return out


@pytest.mark.parametrize(("seed", "words", "shards"), [(mixing.SEED, 2000, 4), (3, 2000, 4), (mixing.SEED, 10**6, 16)])
def test_mix_against_plain_loops(spark, sf_dir, seed, words, shards):
    """The whole documents table, in blocks small enough for many cuts, and the registered query."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = (Q.op3_mix_sources(spark, sf_dir) if words == 10**6 else mixing.mix(docs, block_words=words, n_shards=shards, seed=seed)).collect()
    most = max(r.source_size for r in got) // words + 1
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    order = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most)), lambda b: F.xxhash64(key, b, F.lit(seed)))
    sized = docs.select("doc_id", "source", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("size"), mixing._unit(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("u"), order.alias("order")).collect()
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in got) == plain_mix(sized, words, shards, seed)


def test_tree_decides_what_is_taken(spark, sf_dir, monkeypatch):
    """Other quotas take other documents, and as many words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs, block_words=500, n_shards=4).collect()}
    split = mixing.split_quota
    monkeypatch.setattr(mixing, "split_quota", lambda q, o, seed: split(q, o, seed + 1))
    two = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs, block_words=500, n_shards=4).collect()}
    assert one != two and sum(one.values()) == sum(two.values())


def test_media_round_trip(docs, rows, no_docs):
    got = media.read_back(media.store_texts(docs)).collect()
    assert len(got) == len(rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        b = text[r.doc_id]
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert media.read_back(media.store_texts(no_docs)).count() == 0


@pytest.mark.parametrize("kind", media.KINDS)
def test_sniffing(spark, kind):
    payload = media.pad(b"BM RIFF P5\n %PDF- PK\x03\x04 " * 30)
    blob = media.encode(payload, kind)
    (got,) = media.items(blob)
    assert (got[0], got[1], got[2]) == (kind, 0, len(blob)) and media.samples(blob, got[4]) == payload
    assert media.sniff(blob, "jpeg")[:2] == (kind, True) and media.sniff(blob, kind)[1] is False
    junk = b"some text BM " + blob + b" and \x89PNG\r\n\x1a\n " + media.encode(payload, "png") + b"tail"
    assert [(k, n) for k, _, n in media.sniff(junk, None)[3]] == [(kind, len(blob)), ("png", len(media.encode(payload, "png")))]
    for cut in (blob[:-1], blob[: len(blob) // 2]):
        assert media.items(cut) == []
    df = spark.createDataFrame([(bytearray(blob), "gif"), (bytearray(junk), None), (None, "png")], "b binary, d string")
    r = df.select(media.sniffed(F.col("b"), F.col("d")).alias("x")).collect()
    assert r[0].x.kind == kind and r[0].x.corrected and len(r[1].x.carved) == 2 and r[2].x.kind is None


def test_other_formats():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "x" * 50)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00" + b"\x3b"
    for kind, blob in {"zip": z.getvalue(), "gzip": gzip.compress(b"y" * 99), "gif": gif, "pdf": b"%PDF-1.4\nxref\nstartxref\n0\n%%EOF"}.items():
        assert [(k, a, e) for k, a, e, _, _ in media.items(blob)] == [(kind, 0, len(blob))]


def test_audio_checksums():
    """FLAC frames and Ogg pages count as far as their checksums hold, with other bytes behind."""
    info = struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 15 << 36 | 384).to_bytes(8, "big") + bytes(16)
    flac = b"fLaC" + b"\x80\x00\x00\x22" + info
    for i in range(2):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, i])
        frame = head + bytes([media._crc(head, 0x07, 8)]) + b"\x00" + struct.pack(">h", 5 + i)
        flac += frame + struct.pack(">H", media._crc(frame, 0x8005, 16))
    page = lambda flags, body: (lambda p: p[:22] + struct.pack("<I", media._crc(p, 0x04C11DB7, 32)) + p[26:])(b"OggS\0" + bytes([flags]) + bytes(16) + bytes(4) + bytes([1, len(body)]) + body)
    ogg = page(2, b"x" * 40) + page(4, b"y" * 9)
    for kind, blob in (("flac", flac), ("ogg", ogg)):
        assert [(k, a, e) for k, a, e, _, _ in media.items(b"junk" + blob + b"more OggS bytes")] == [(kind, 4, 4 + len(blob))]
        bad = bytearray(blob)
        bad[-5] ^= 1
        assert [e for _, _, e, _, _ in media.items(bytes(bad))] in ([], [len(page(2, b"x" * 40))])


def test_many_signatures_take_one_pass():
    import time

    blob = b"PK\x03\x04 %PDF-1.4 " * 40_000 + b"PK\x05\x06" * 1000
    began = time.time()
    assert media.items(blob) == [] and time.time() - began < 20


def test_registered_media_against_brute_force(spark, sf_dir):
    """The whole documents table: what is read back is the padded text."""
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = Q.op7_media_columns(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        b = text[r.doc_id]
        p = b + b" " * (-len(b) % 192 if b else 192)
        blob = media.encode(p, media.KINDS[zlib.crc32(p) % len(media.KINDS)])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(blob), hashlib.sha256(blob).hexdigest())


def test_archives(spark, tmp_path):
    pages = [(i, f"http://x/{i}\r\nEvil: 1", ["<p>same</p>", f"<p>{i}é</p>" * 200, None, ""][i % 4]) for i in range(40)] + [(None, None, "<p>same</p>"), (None, None, "<p>lone</p>"), (3, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("clash"))
    manifest = warc.write(df, f"file://{tmp_path}/w", roll=2_000)
    assert manifest.count() > 3
    got = warc.read(manifest).collect()
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = collections.Counter()
    for i, _, h in pages:
        b, top = (h or "").encode(), best[h or ""]
        same = top == -1 or i == top
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else top] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.round_trip(df.limit(0)).count() == 0
    plain, shuffled = (sorted(map(str, warc.with_revisits(df, 0, n).collect())) for n in (10**6, 0))
    assert plain == shuffled
    assert warc.with_revisits(df, min_bytes=5).where("refers_to is not null and octet_length(html) < 5").count() == 0


def test_registered_archives_against_brute_force(spark, sf_dir):
    """The whole pages table, with a page of some megabytes beside it."""
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    long = (10**9, "<p>é</p>" * 700_000)
    best = {}
    for i, h in rows + [long]:
        best[h or ""] = max(best.get(h or "", i), i)

    def want(rows):
        return {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if best[h or ""] == i else ("revisit", best[h or ""]))) for i, h in rows}

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert {tuple(r) for r in Q.op8_warc(spark, sf_dir).select(columns).collect()} == want(rows)
    two = spark.createDataFrame([(*long, "u"), (5, "x", "u")], "page_id long, html string, url string")
    assert {tuple(r) for r in warc.round_trip(two).select(columns).collect()} == want([long]) | {(5, 1, base64.b32encode(hashlib.sha1(b"x").digest()).decode(), "response", None)}


def test_archive_layout():
    a = warc.Archive()
    recs = [warc.record(i, f"http://example.org/{i}", (f"<html><body>page {i} " + "common words " * 30).encode(), None) for i in range(9000)]
    for r in recs:
        a.add(r)
    data = a.close()
    magic, n = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 0 < n <= 112 << 10 and list(warc.records(data)) == recs
    with pytest.raises(ValueError):
        list(warc.records(data[:-3]))


def test_decontamination(spark, docs, rows, no_docs):
    base = rows[0][1].split()
    bench = spark.createDataFrame([(1, " ".join(base[20:45])), (2, "Short, TEXT!"), (3, None), (4, "!!"), (10, " ".join(base[30:40])), (11, "nowhere " * 12), (None, " ".join(base[:12]))], "item_id long, text string")
    items = [(r.item_id, (r.text or "")) for r in bench.collect()]

    def words(t):
        import re

        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    wins = [(i, tuple(w[a : a + 10])) for i, t in items for w in [words(t)] for a in range(max(1, len(w) - 9)) if w]
    want = collections.Counter()
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for i, g in wins:
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    ids.add(i)
        ids = sorted(str(i) for i in ids if i is not None)
        want[r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    docs = docs.withColumns({"__k1": F.lit(1), "__K2": F.lit("x"), "__spans": F.lit(2), "pos": F.lit(3), "k1": F.lit(4)})
    for limits in ((20_000, 20_000), (0, 7)):  # the sets at once, and beyond their bounds
        got = decontaminate.report(docs, bench, 10, *limits).drop("items").collect()
        assert collections.Counter(tuple(r) for r in got) == want
        clean = decontaminate.decontaminate(docs, bench, "document", 10, *limits)
        assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
        cut = decontaminate.decontaminate(docs, bench, "span", 10, *limits)
        assert cut.count() == len(rows) and cut.where("text like '%" + " ".join(base[30:40]) + "%'").count() == 0
        again = decontaminate.report(cut, bench).agg(F.sum("n_words")).first()[0]
        assert again == sum(k[1] * n - k[2] * n for k, n in want.items())
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(no_docs, bench).count() == 0


def test_decontamination_by_a_large_benchmark(spark):
    """200 000 windows, most of which start with the same few words."""
    bench = spark.range(2000).select(F.col("id").alias("item_id"), F.array_join(F.concat(F.array(F.lit("the of and")), F.transform(F.sequence(F.lit(0), F.lit(105)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 107 + i) % 500_021).cast("string")))), " ").alias("text"))
    assert decontaminate.item_windows(bench).count() > 190_000
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("the of and "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("w"), (F.col("id") * 40 + i * F.when(F.col("id") % 3 == 0, 1).otherwise(2)).cast("string"))), " ")).alias("text"))
    for limits in ((10**6, 10**6), (1000, 90_000)):
        got = decontaminate.report(docs, bench, 10, *limits).collect()
        assert all(r.contaminated == (r.doc_id % 3 == 0) and r.n_words == 34 for r in got) and len(got) == 300
