"""LM scoring: an interpolated modified Kneser-Ney model in sorted hash arrays.

The model has any ``order`` from 2 on; none of its n-grams is pruned or sampled. A pass over the
training texts counts the longest n-grams. A pass for each shorter length k then looks the
(k + 1)-grams of its texts up in the table made before, and gathers for every k-gram, as sums
over its places: how often it occurs, how many different words come before it (the sum of one
over the longer gram's count; the plain count where it begins a text), and as a context the
count of what follows and the mass its discounts leave. The last pass scores all texts, one
lookup a token and length; workers memory-map the tables. Counts are merged within a batch
before they are sent, so a frequent word or a hot source costs an entry a batch, and tables are
sharded by hash. The driver only receives counts of counts and totals.

Tokens are words of A-Z lowered text, then one end; before the first word the context is
start marks. N-grams are known by 64-bit hashes of their tokens' hashes.

Defined cases: null texts are empty (one token, the end); without training texts every token
has probability 1 (a vocabulary of nothing but the unknown word); repeated rows count and score each; an
empty table gives an empty result; null doc_ids are not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sorted_arrays import BYTE, U, Arrays, merge, mix, powers, runs, shards_for, split, sum_by_key, text_bytes

END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
ORDER = 3
#: Bytes of text whose tokens are hashed together and scored together, and tokens merged before they are sent.
CHUNK, SCORED, BATCH = 1 << 18, 6 << 20, 1_500_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts (an end after each), and the index of each text's end."""
    low, space = _LOWER[data], _SPACE[data]
    power, inverse = powers(len(data) + 1)
    sums = np.append(U(0), np.cumsum(BYTE[low] * power[: len(low)], dtype=np.uint64))
    before = np.append(True, space[:-1]) if len(space) else space
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.append(space[1:], True) if len(space) else space
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    first, last = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
    h = mix((sums[last + 1] - sums[first]) * inverse[first] + (last - first + 1).astype(np.uint64) * U(0xD1B54A32D192ED03))
    n = np.diff(np.searchsorted(first, offsets))
    ends = np.cumsum(n + 1) - 1
    out = np.empty(len(h) + len(n), np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = h
    out[ends] = END
    return out, ends


def padded(tok: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts with order - 1 start marks before each text, and each one's place in its text (marks
    have negative ones)."""
    n = np.diff(np.append(-1, ends))
    pad = order - 1
    first = np.cumsum(n + pad) - n - pad
    place = np.arange(len(tok) + pad * len(n)) - np.repeat(first, n + pad) - pad
    out = np.full(len(place), START, np.uint64)
    out[place >= 0] = tok
    return out, place


def grams(x: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1 to order, the hashes of the n-grams that end at each place of x (meaningless where they
    would begin before x)."""
    out = [x]
    for _ in range(order - 1):
        out.append(mix(np.append(U(0), out[-1][:-1]) * U(0xA0761D6478BD642F) + x))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        data, offsets = text_bytes(b.column(column))
        for a, z in runs(offsets, size):
            tok, ends = tokens(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            yield b, a, z, tok, ends


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(0, x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def _histogram(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


class Table:
    """The arrays of one length k: count, number of words before (the count for the longest), and as a context (of
    all but the longest) what follows and the share left to shorter contexts."""

    def __init__(self, arrays: Arrays, d: tuple[float, float, float], longest: bool):
        self.arrays, self.d, self.longest = arrays, np.array([0.0, *d]), longest

    def cut(self, a: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(a, 3).astype(np.int64)]


class Model:
    """What workers need: a table for each length, and a few totals."""

    def __init__(self, tables: list[Table], n: int, v: int, types: int, spare: float):
        self.tables, self.order, self.n, self.v, self.types, self.spare = tables, len(tables), n, v, types, spare

    def score(self, tok: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, score (log10)."""
        x, place = padded(tok, ends, self.order)
        rows = np.flatnonzero(place >= -1)  # tokens, and the mark before the first of them
        word = place[rows] >= 0
        keys = grams(x, self.order)
        p = None
        for k, t in enumerate(self.tables):
            if t.longest:
                _, (a,) = t.arrays.find(keys[k][rows][word], ["u4"])
            else:
                _, (c, a_, total_, left_) = t.arrays.find(keys[k][rows], ["u4", "u4", "f8", "f4"])
                a = a_[word]
            seen = np.maximum(a - t.cut(a), 0)
            if k == 0:
                known = c[word]
                p = seen / self.types + self.spare / (self.v + 1) if self.types else np.full(len(tok), 1.0 / (self.v + 1))
            else:
                p = np.where(total > 0, seen / np.maximum(total, 1) + left * p, p)
            if not t.longest:  # a token's context ends at the row before it
                total, left = np.append(0.0, total_[:-1])[word], np.append(0.0, left_[:-1])[word]
        base = np.log10((known + 1.0) / (self.n + self.v + 1.0))
        first = np.append(0, ends[:-1] + 1)
        add = lambda y: np.add.reduceat(y, first)
        return np.diff(np.append(-1, ends)), add((known > 0).astype(np.int64)), add(base), add(np.log10(p))


def train(texts: DataFrame, n_bytes: int, order: int = ORDER) -> Model:
    """texts: column text; n_bytes: about how large they are together, which sets the number of shards."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    shards = shards_for(n_bytes)
    texts = texts.select("text")

    def batched(merged: Callable) -> Callable:
        """A task that gives merged(texts' tokens, their ends) of about BATCH tokens at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for _, _, _, tok, ends in _chunks(batches, 0, CHUNK):
                held.append((tok, ends + size))
                size += len(tok)
                if size >= BATCH:
                    yield merged(*(np.concatenate(c) for c in zip(*held)))
                    held, size = [], 0
            if size:
                yield merged(*(np.concatenate(c) for c in zip(*held)))

        return run

    def count(tok: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        x, place = padded(tok, ends, order)
        k, n = np.unique(grams(x, order)[-1][place >= 0], return_counts=True)
        return split(k, [n.astype(np.uint32)], shards)

    def finish_count(k: np.ndarray, c: list[np.ndarray]) -> tuple:
        k, (n,) = sum_by_key(k, c)
        n = n.astype(np.uint32)
        return k, [n], tuple(_histogram(n))

    path, rows = merge(texts.mapInArrow(batched(count), "shard int, blob binary"), ["u4"], shards, finish_count, "n1 long, n2 long, n3 long, n4 long", f"lm-{order}")
    tables = [Table(Arrays(path, shards), discounts(_sums(rows)[:4]), True)]
    for k in range(order - 1, 0, -1):
        longer, top = tables[0], k == order - 1

        def gather(tok: np.ndarray, ends: np.ndarray, k: int = k, longer: Table = longer, top: bool = top) -> pa.RecordBatch:
            x, place = padded(tok, ends, k + 1)
            rows = np.flatnonzero(place >= -1)
            place = place[rows]
            word = place >= 0
            keys = grams(x, k + 1)
            _, got = longer.arrays.find(keys[k][rows][word], ["u4"] if top else ["u4", "u4"])
            n, a = np.maximum(got[0], 1), got[-1]
            left, total, mass = (np.zeros(len(rows)) for _ in range(3))
            left[word] = np.where(place[word] < k - 1, 1.0, 1.0 / n)
            before = np.flatnonzero(word) - 1
            mass[before] = longer.cut(a) / n
            total[before] = a / n
            key, cols = sum_by_key(keys[k - 1][rows], [np.ones(len(rows), np.uint32), left, mass] + [total] * (not top))
            return split(key, [cols[0].astype(np.uint32), *cols[1:]], shards)

        def finish(key: np.ndarray, c: list[np.ndarray], top: bool = top) -> tuple:
            key, cols = sum_by_key(key, [c[0].astype(np.uint64), *c[1:]])
            n, left, mass = cols[:3]
            a = np.rint(left).astype(np.uint32)
            total = n.astype(np.float64) if top else np.rint(cols[3])
            share = (mass / np.maximum(total, 1)).astype(np.float32)
            real = key != START
            row = (*_histogram(a), int(n[real].sum()), int(real.sum()), int(a.sum()), int((a > 2).sum()))
            return key, [np.minimum(n, 2**32 - 1).astype(np.uint32), a, total, share], row

        kinds = ["u4", "f8", "f8"] + ["f8"] * (not top)
        result = "n1 long, n2 long, n3 long, n4 long, n long, v long, types long, many long"
        path, rows = merge(texts.mapInArrow(batched(gather), "shard int, blob binary"), kinds, shards, finish, result, f"lm-{k}")
        totals = _sums(rows)
        tables.insert(0, Table(Arrays(path, shards), discounts(totals[:4]), False))
    n1, n2, _, _, n, v, types, many = totals
    d = tables[0].d
    spare = (d[1] * n1 + d[2] * n2 + d[3] * many) / types if types else 1.0
    return Model(tables, n, v, types, spare)


def _sums(rows: DataFrame) -> list[int]:
    return [int(x or 0) for x in rows.agg(*[F.sum(c) for c in rows.columns]).first()]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, model: Model | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text."""
    if model is None:
        texts = docs.where(~held_out()).select(F.col("text").cast("string").alias("text"))
        model = train(texts, docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0, order)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths and totals only

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b, a, z, tok, ends in _chunks(batches, 2, SCORED):
            n, known, base, s = m.score(tok, ends)
            part = b.slice(a, z - a)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(z - a, m.n, np.int64)), pa.array(base), pa.array(s), pa.array(10.0 ** np.minimum(300.0, -s / n))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
