"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Windows of ten words of each benchmark item (an item of fewer words is one window) are hashed by
their first words; the set of these anchors is broadcast. Each document's word positions stream
past it inside one stage: a position whose anchor is in the set is a candidate, and the text of
the whole window, joined with the windows, decides whether it is a hit, so hash collisions never
count. What leaves the stage are hits only; a hot passage costs its own rows, copies of a text
are merged before the shuffle.

It is one plan for any benchmark. Its sizes are counted: more than ``max_anchors`` anchors are dealt
to several sets, each of which the documents stream past in turn; more than ``max_windows`` windows
are joined with the candidates by a shuffle instead of a broadcast.

Hits belong to texts (a 128-bit hash), and documents get them by a join on it: broadcast up to
``MAX_KEYS`` texts, else by a shuffle.

Defined cases: null or empty texts have no words and no hits; a null item text has no
window; items with equal texts each count; a null item_id is ignored in item lists;
repeated document rows each give a row; an empty benchmark hits nothing; other columns of
either table are never touched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, text_or_empty, unused

#: A word of the contract, on lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in text of any case, each with the separators that follow it.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
N = 10
ANCHOR = 3
#: Rows broadcast at most: anchors (a number each), windows and texts with hits (some hundred bytes each).
MAX_ANCHORS, MAX_WINDOWS, MAX_KEYS = 2_000_000, 200_000, 100_000


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(c), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(gram, len, anchor, items): the distinct windows and the items that have them."""
    w = benchmark.select("item_id", words_of(text_or_empty()).alias("w")).where(F.size("w") > 0)
    size = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - F.lit(n - 1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("g"))
    return (
        w.select("item_id", F.array_join("g", " ").alias("gram"), F.size("g").alias("len"), _anchor(F.col("g"), F.lit(0), ANCHOR).alias("anchor"))
        .groupBy("gram", "len", "anchor")
        .agg(F.collect_set("item_id").alias("items"))
    )


def _anchor(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(k)])


def _key() -> list[Column]:
    return [F.xxhash64(text_or_empty()).alias("k1"), F.xxhash64(F.lit(1), text_or_empty()).alias("k2")]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS, max_anchors: int = MAX_ANCHORS) -> tuple[DataFrame, int]:
    """(k1, k2, spans, items) of each distinct text with hits: array<struct<pos, len>> by position and the items, of
    which a window occurs; a written table, and its number of rows."""
    table = settle(item_windows(benchmark, n), "decontaminate-windows")
    n_windows, n_anchors, kinds = table.agg(F.count(F.lit(1)), F.count_distinct("anchor"), F.collect_set(F.least("len", F.lit(ANCHOR)))).first()
    near = lambda df, count, most: F.broadcast(df) if count <= most else df
    anchors = table.groupBy("anchor").agg(F.collect_set("len").alias("lens"))  # at most n lengths
    w = F.col("w")
    anchor = lambda k: lambda _, i: _anchor(w, i, k)
    places = F.concat(*[F.transform(w, anchor(k)) for k in sorted(kinds) or [ANCHOR]])  # one after the other
    at = docs.select(*_key(), words_of(text_or_empty()).alias("w")).select("k1", "k2", "w", F.posexplode(places).alias("pos", "anchor"))
    sets = -(-n_anchors // max_anchors) or 1
    part = lambda i: anchors.where(F.pmod(F.xxhash64(F.lit(3), "anchor"), F.lit(sets)) == i)
    passed = reduce(DataFrame.unionByName, [at.join(F.broadcast(part(i)), "anchor") for i in range(sets)])
    passed = passed.select("k1", "k2", "w", (F.col("pos") % F.size("w")).alias("pos"), F.explode("lens").alias("len")).where(F.col("pos") + F.col("len") <= F.size("w"))
    passed = passed.select("k1", "k2", "pos", "len", F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ").alias("gram"))
    found = passed.join(near(table.select("gram", "len", "items"), n_windows, max_windows), ["gram", "len"])
    spans = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    out = settle(spans, "decontaminate-hits")
    return out, out.count()


def covered(spans: Column) -> Column:
    """Number of words inside the union of spans sorted by position."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("n"),
        F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def _with_hits(docs: DataFrame, found: DataFrame, count: int, how: str, *columns: str) -> DataFrame:
    """docs joined with the hits of their texts; columns (of found) get the names that unused() gives them."""
    k1, k2 = unused(docs, "__k1", "__k2")
    names = unused(docs, *(f"__{c}" for c in columns))
    right = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), *(F.col(c).alias(x) for c, x in zip(columns, names)))
    keyed = docs.withColumns(dict(zip((k1, k2), _key())))
    return keyed.join(F.broadcast(right) if count <= MAX_KEYS else right, [k1, k2], how).select(*docs.columns, *([] if how == "left_anti" else names))


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, per document row."""
    docs = docs.select("doc_id", "text")
    found, count = hits(docs, benchmark, n, max_windows, max_anchors)
    base = _with_hits(docs, found, count, "left", "spans", "items")
    items = F.array_sort(F.transform(F.coalesce("__items", F.array()), lambda x: x.cast("string")))
    base = base.select("doc_id", F.regexp_count(ascii_lower(text_or_empty()), F.lit(WORD)).cast("long").alias("n_words"), F.coalesce(covered(F.col("__spans")), F.lit(0)).alias("n_hit"), items.alias("items"))
    return base.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = N, max_windows: int = MAX_WINDOWS, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """docs without their contaminated documents (mode "document") or without the words inside
    hit windows (mode "span"). Clean documents come back byte for byte; columns stay as they are."""
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode!r}")
    found, count = hits(docs.select("text"), benchmark, n, max_windows, max_anchors)
    if mode == "document":
        return _with_hits(docs, found, count, "left_anti")
    marked = _with_hits(docs, found, count, "left", "spans")
    spans = F.col(marked.columns[-1])
    return marked.withColumn("text", F.when(spans.isNull(), F.col("text")).otherwise(_cut(F.col("text"), spans))).select(*docs.columns)


def _cut(text: Column, spans: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    lead = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"])))
    return F.when(F.size(spans) > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(text)


ORACLE_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM dw WHERE len(w) > 0),
grams AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM pos JOIN ks ON i + k - 1 <= len(w)),
hits AS (SELECT DISTINCT g.rid, g.i, g.k, win.item_id FROM grams g JOIN win ON g.gram = win.gram AND g.k = win.k),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids, list(s ORDER BY s) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
"""
