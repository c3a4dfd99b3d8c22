"""Near-duplicate classes by DartMinHash, banded joining and an exact check.

Signatures. Darts fall on the plane (weight, rank) of every element with one dart a unit cell
on average, their number and places given by hashes of the element and the cell. A weighted
set of total weight W sees the darts below each element's weight and below rank t / W: about
t darts in all, however many elements it has. Each dart hashes to one of k coordinates, and
the lowest rank of a coordinate is its value. t = k ln k + 2k fills all coordinates for most
sets; for the others t doubles until it does. Equal values of a coordinate have the
probability of the weighted Jaccard similarity. A shingle's weight is how often the text has it.
What is confirmed in the end is the similarity of the sets of shingles, and copies that differ in how
often they repeat a passage can be far apart by weights: a text that repeats a shingle also gets the
signature of its set (all weights 1, which is the weighted signature of any text without repeats).

Joining. Documents with equal words collapse first, by hash, so groups of copies of any size
count once. k coordinates make ``bands`` keys of ``rows`` coordinates. Of the documents that
share a key, shingles that no other has are counted: they bound every similarity from above,
which rules out documents and pairs exactly. So does a parity map of each set: every shingle
flips one of 512 bits, so two maps differ in at most as many bits as the sets do in shingles
(the bitmap filter of exact set similarity joins). Within a key's bucket documents are not paired
with each other but with hubs: one in the first round, then ``hubs`` and four times as many in each
further one, chosen among those not in the bucket's largest class, first those with the
smallest share of shingles of their own (the original before its edited copies). A hub is
checked against all members of other classes, then leaves the bucket, so nothing is lost, and
a bucket is done when what remains is of one class: near copies need a hub or two however
many they are.

Pairs are confirmed by the similarity of their sets of five-word shingles (64-bit hashes of their
words), and classes are the connected components. Nothing is capped. Members are dealt to tasks by
document, not by key, and meet hubs by broadcast, so a key of very many documents is no task's
alone. All tables between rounds are written to the shared folder.

Defined cases: words are runs of anything but ASCII white space, A-Z lowered; a text of fewer
than five words is one shingle; texts without words (also null) are one class; doc_id is a whole
number and taken as unique, and rows of equal doc_id as one document with all its texts; a document
without doc_id gets the class of its copies, or null; a class's id is its smallest doc_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKEN, ascii_lower, settle, text_or_empty, unused

SHINGLE = 5
BANDS, ROWS = 25, 5
MAPS = [f"p{i}" for i in range(8)]  # 64 bits each of the parity map
_U = np.uint64
_CDF = np.array([int(sum(math.exp(-1) / math.factorial(j) for j in range(n + 1)) * 2**32) for n in range(13)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def dart_minhash(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """uint64 [n_sets, k] signatures of weighted sets. elements: uint64 hashes; weights: positive;
    sets: which set each belongs to. A set without elements keeps zeros."""
    out = np.zeros((n_sets, k), np.uint64)
    total = np.bincount(sets, weights=weights, minlength=n_sets)
    open_ = total > 0
    t = k * math.log(k) + 2 * k
    while open_.any():
        use = open_[sets]
        e, w, s = elements[use], weights[use], sets[use]
        theta = t / np.maximum(total, 1e-300)
        ranks = np.ceil(theta[s]).astype(np.int64)
        cells = np.ceil(w).astype(np.int64) * ranks
        at = np.repeat(np.arange(len(e)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        rank, level = cell % ranks[at], cell // ranks[at]
        g = _mix(e[at] + _mix(rank.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + level.astype(np.uint64) * _U(0xD1B54A32D192ED03) + _U(1)))
        n = np.searchsorted(_CDF, g >> _U(32), side="right")
        hit = np.flatnonzero(n)
        dart = np.repeat(hit, n[hit])
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
        d = _mix(g[dart] + (nth + 1).astype(np.uint64) * _U(0xA0761D6478BD642F))
        place = _mix(d + _U(0xE7037ED1A0B428DB))
        height = rank[dart] + (d & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        own = s[at[dart]]
        keep = height < theta[own]
        if (w != np.ceil(w)).any():
            keep &= level[dart] + (place & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < w[at[dart]]
        d, place, height, own = d[keep], place[keep], height[keep], own[keep]
        slot = own * k + ((place >> _U(32)) % _U(k)).astype(np.int64)
        order = np.argsort(-height, kind="stable")
        sig = np.zeros(n_sets * k, np.uint64)
        sig[slot[order]] = d[order] | _U(1)  # the last to be written, of the lowest rank, stays
        sig = sig.reshape(n_sets, k)
        full = open_ & (sig != 0).all(1)
        out[full] = sig[full]
        open_ &= ~full
        t *= 2
    return out


def shingles(words: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text (all words of a shorter one), and their texts."""
    begins = np.append(0, ends[:-1])
    n = ends - begins
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        h = _mix(h * _U(3) + words[j : j + len(h)])
    text = np.repeat(np.arange(len(ends)), n)
    where = np.flatnonzero(np.arange(len(h)) + size <= ends[text[: len(h)]])
    short = np.flatnonzero((n > 0) & (n < size))
    extra = np.zeros(len(short), np.uint64)
    for i, x in enumerate(short):
        for v in words[begins[x] : ends[x]]:
            extra[i : i + 1] = _mix(extra[i : i + 1] * _U(5) + v)
    return np.append(h[where], extra), np.append(text[where], short)


def _multiplicity(e: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((e, s))
    e, s = e[order], s[order]
    first = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (s[1:] != s[:-1]))) if len(e) else np.zeros(0, np.int64)
    return e[first], np.diff(np.append(first, len(e))).astype(np.float64), s[first]


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def _bands(bands: int, rows: int, weighting: str):
    k = bands * rows

    def keys_of(e: np.ndarray, w: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        sig = dart_minhash(e, w, s, n, k).reshape(n, bands, rows)
        h = np.zeros((n, bands), np.uint64)
        for j in range(rows):
            h = _mix(h * _U(3) + sig[:, :, j])
        return h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
            words = lists.flatten().to_numpy().view(np.uint64)
            parts, owners = [np.zeros((0, bands), np.uint64)], [np.zeros(0, np.int64)]
            a = 0
            while a < len(lists):  # some hundred thousand darts at a time
                base = ends[a - 1] if a else 0
                z = max(a + 1, min(a + max(1, 100_000 // k), int(np.searchsorted(ends, base + 300_000, side="right"))))
                e, w, s = _multiplicity(*shingles(words[base : ends[z - 1]], ends[a:z] - base))
                parts.append(keys_of(e, w if weighting != "set" else np.ones(len(e)), s, z - a))
                owners.append(np.arange(a, z))
                if weighting == "both" and len(again := np.unique(s[w > 1])):
                    use = np.isin(s, again)
                    parts.append(keys_of(e[use], np.ones(int(use.sum())), np.searchsorted(again, s[use]), len(again)))
                    owners.append(a + again)
                a = z
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            keys = np.concatenate(parts)[order].view(np.int64)
            n = np.bincount(owner, minlength=len(lists)) * bands
            flat = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(np.append(0, ends))), flat], ["doc_id", "h1", "h2", "n", "bands"])

    return run


def _small(df: DataFrame, limit: int) -> DataFrame:
    """df (a written table), marked for broadcast if it is counted to have at most limit rows."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame, name: str = "components", max_broadcast: int = 100_000) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex of its component. Each round
    hooks components to their smallest neighbour, follows two pointers, and contracts the edges."""
    both = settle(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = None
    while not both.isEmpty():
        ends = both.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(both.select(F.col("b").alias("v"), F.col("a").alias("u")))
        hook = settle(ends.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("c")), name)
        up = _small(hook.select(F.col("v").alias("c"), F.col("c").alias("up")), max_broadcast)
        for _ in range(2):
            hook = hook.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
        hook = settle(hook, name)
        if labels is None:
            labels = hook
        else:
            moved = _small(hook.select(F.col("v").alias("c"), F.col("c").alias("to")), max_broadcast)
            labels = settle(labels.join(moved, "c", "left").select("v", F.coalesce("to", "c").alias("c")), name)
        to = _small(hook.select(F.col("v").alias("a"), F.col("c").alias("ca")), max_broadcast)
        there = _small(hook.select(F.col("v").alias("b"), F.col("c").alias("cb")), max_broadcast)
        next_ = both.join(to, "a").join(there, "b").where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        both = settle(next_.distinct(), name)
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c")).limit(0)
    return labels


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, weighting: str = "both", hubs: int = 16, max_broadcast: int = 100_000) -> DataFrame:
    """doc_id and class_id of every document. weighting: "both" and "set" compare sets of shingles, by signatures of
    counted shingles and of sets or of sets alone; "count" compares counted shingles (weighted Jaccard)."""
    if weighting not in ("both", "set", "count"):
        raise ValueError(f"unknown weighting {weighting!r}")
    wh = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(text_or_empty()).alias("w"))
    wh = wh.select("doc_id", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(7), "w").alias("h2"), "w")
    signed = settle(wh.mapInArrow(_bands(bands, rows, weighting), "doc_id long, h1 long, h2 long, n long, bands array<long>"), "minhash-signed")
    reps = settle(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("v"), F.min("n").alias("n"), F.min_by("bands", "doc_id").alias("bands")), "minhash-texts")
    known = reps.where(F.col("v").isNotNull() & (F.col("n") > 0))
    each = known.select("v", F.posexplode("bands").alias("band", "value")).select("v", F.xxhash64(F.col("band") % bands, "value").alias("key")).distinct()
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    members = settle(each.join(several, "key").repartition("v"), "minhash-members")  # not by key: a hot one would be one task's

    # the exact sets of those who share a bucket, and of how many shingles no other of them has
    ids = _small(settle(members.select("v").distinct(), "minhash-candidates"), 10 * max_broadcast)  # a number each
    size = F.size("w")
    text = docs.select(F.col("doc_id").cast("long").alias("v"), text_or_empty().alias("text")).join(ids, "v").select("v", word_hashes(F.col("text")).alias("w"))
    sets = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - F.lit(SHINGLE - 1))), lambda i: F.xxhash64(F.slice("w", i, SHINGLE)))
    if weighting == "count":  # an occurrence is an element: the sets' similarity is then the weighted one
        sets = F.sort_array(sets)
        sets = F.transform(sets, lambda h, i: F.xxhash64(h, i - F.array_position(sets, h).cast("int")))
    sets = settle(text.select("v", F.array_distinct(sets).alias("s")), "minhash-sets")
    own = sets.select("v", F.explode("s").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("v")).where("m = 1")
    own = own.groupBy("v").agg(F.count(F.lit(1)).alias("own"))
    info = sets.select("v", F.size("s").alias("n")).join(own, "v", "left").select("v", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    # what is its own can't be shared: a set with less than the threshold in common has no partner
    info = info.where(F.col("common") >= threshold * F.col("n") - 1e-9).groupBy("v").agg(F.min("n").alias("n"), F.max("common").alias("common"), F.count(F.lit(1)).alias("texts"))
    info = info.join(_parity(sets), "v").select("v", "n", "common", *(F.when(F.col("texts") == 1, F.col(p)).alias(p) for p in MAPS))
    info = settle(info, "minhash-info")
    left = members.join(_small(info, max_broadcast), "v")
    labels = info.select("v", F.col("v").alias("c"))

    slots = 1
    while True:
        here = left.join(_small(labels, max_broadcast), "v")
        per = here.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("c", "m").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "top")
        here = settle(here.join(_small(settle(per, "minhash-keys"), 5 * max_broadcast), "key"), "minhash-open")
        if here.isEmpty():
            break
        outside = here.where("c != top") if slots > 1 else here
        chosen = outside.groupBy("key", F.pmod(F.xxhash64("v", F.lit(slots)), F.lit(slots)).alias("slot")).agg(F.min(F.struct((1 - F.col("common") / F.col("n")).alias("p"), F.xxhash64("v", F.lit(99)).alias("q"), "v", "c", "n", "common", *MAPS)).alias("h"))
        chosen = settle(chosen.select("key", F.col("h.v").alias("hub"), F.col("h.c").alias("hc"), F.col("h.n").alias("hn"), F.col("h.common").alias("hcommon"), *(F.col(f"h.{p}").alias(f"h{p}") for p in MAPS)), "minhash-hubs")
        possible = F.least("common", "hcommon") * (1 + threshold) >= threshold * (F.col("n") + F.col("hn")) - 1e-9
        differ = reduce(add, (F.bit_count(F.col(p).bitwiseXOR(F.col(f"h{p}"))) for p in MAPS))
        possible &= F.coalesce(differ * (1 + threshold) <= (1 - threshold) * (F.col("n") + F.col("hn")) + 1e-9, F.lit(True))
        met = here.join(_small(chosen, max_broadcast), "key").where((F.col("c") != F.col("hc")) & possible)
        pairs = settle(met.select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct(), "minhash-pairs")
        new = _confirm(pairs, sets, threshold)
        to, there = labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), labels.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        joined = components(new.join(_small(to, max_broadcast), "a").join(_small(there, max_broadcast), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), max_broadcast=max_broadcast)
        moved = joined.select(F.col("v").alias("c"), F.col("c").alias("to"))
        labels = settle(labels.join(_small(moved, max_broadcast), "c", "left").select("v", F.coalesce("to", "c").alias("c")), "minhash-labels")
        gone = chosen.select("key", F.col("hub").alias("v"))
        left = here.select("key", "v", "n", "common", *MAPS).join(_small(gone, max_broadcast), ["key", "v"], "left_anti")
        slots = hubs if slots == 1 else 4 * slots

    named = reps.join(_small(labels, max_broadcast), "v", "left").select("h1", "h2", F.coalesce("c", "v").alias("class_id"))
    return signed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "class_id")


def _parity(sets: DataFrame) -> DataFrame:
    """v and its set's parity map. Of a v with several sets the maps add up and mean nothing."""
    bits = sets.select("v", F.explode("s").alias("e")).select("v", F.xxhash64("e").alias("e"))
    word, bit = F.col("e").bitwiseAND(7), F.expr("shiftleft(1L, int(shiftright(e, 3) & 63))")
    return bits.groupBy("v").agg(*(F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(p) for i, p in enumerate(MAPS)))


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets' similarity reaches threshold."""
    one, two = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    got = pairs.join(two, "b").join(one, "a")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    got = got.where(small >= threshold * large - 1e-9)
    both = F.size(F.array_intersect("sa", "sb"))
    got = got.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return got.where(F.col("i") >= threshold * (F.col("n") - F.col("i")) - 1e-9).select("a", "b")


def deduplicate(docs: DataFrame, max_broadcast: int = 500_000, **options) -> DataFrame:
    """One document of each class: that with the smallest doc_id (one row of it). Rows without doc_id
    stay; columns stay as they are. The ids that go, or those that stay if they are fewer, are broadcast
    if they are counted to be at most max_broadcast."""
    found = settle(classes(docs.select("doc_id", "text"), **options).where(F.col("doc_id").isNotNull()), "minhash-classes")
    stays = F.col("doc_id") == F.col("class_id")
    kept, gone, again = found.agg(F.count_if(stays), F.count_if(~stays), F.count(F.lit(1)) - F.count_distinct("doc_id")).first()
    (name,) = unused(docs, "__id")
    which, how = (~stays, "left_anti") if gone <= kept else (stays, "left_semi")
    ids = found.where(which).select(F.col("doc_id").alias(name)).distinct()
    known = docs.where(F.col("doc_id").isNotNull())
    out = known.join(F.broadcast(ids) if min(kept, gone) <= max_broadcast else ids, F.col("doc_id").cast("long") == F.col(name), how)
    if again:
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
