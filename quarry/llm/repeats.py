"""Exact repeated-substring removal by prefix-free parsing.

Parse. A rolling hash of every 32 bytes marks triggers: the place whose hash is lowest within
some 100-byte window. A phrase is the stretch of a text whose windows share a trigger, with
the bytes those windows need, so phrases overlap, every window lies inside the one phrase
that owns it, and which phrase, and where in it, depends on the window's content alone: equal
windows have equal triggers at equal places. The dictionary is the set of distinct phrases;
highly repetitive text has few. The parse is the list of phrases' places in corpus order
(doc_id, place). It is grouped by trigger: of each distinct phrase the first place counts
further, and a later one repeats all its windows.

Suffix arrays. Windows can only be equal between distinct phrases of one trigger (edges of
repeated passages, near copies). The dictionary's phrases of such triggers are dealt to shards
by trigger; a shard builds the suffix array of its phrases by prefix doubling (8, 16, 32, 64
and then ``length`` bytes, compared as bytes, not as hashes). Suffixes whose first ``length`` bytes
are equal are neighbours in it. A window needs nothing beyond its phrase, so no order of the
parse has to break ties: the dictionary's order and the parse's first places combine into
the first place of each window in corpus order, and its other places are repeats.

A trigger of over ``HOT`` distinct phrases (the edge of a passage that very many documents share) is
split: its phrases' windows are dealt to all shards by a 128-bit fingerprint and compared by
it. Occurrences are merged within each batch before they are sent, so a hot passage costs an
entry a batch and not an entry a document.

Nothing is looked up: parses go to the shards of their triggers, answers go to the shards of
their documents, where the texts are sent too (twice: for the bytes of the phrases that are
asked for, and for the removal).

Exactness: phrases of one trigger count as equal by a 64-bit hash of their bytes (two of them
are wrongly taken for one with a probability of 2^-64 a pair of phrases of the same trigger),
windows by their bytes, those of hot triggers by 128 bits.

Defined cases: null texts are empty; texts under ``length`` bytes lose nothing; matches never
cross texts; doc_id is a whole number and taken as unique (rows that share doc_id and text get
equal results, as one occurrence); a null doc_id comes first in corpus order; an empty table
gives an empty result; a text of any length is parsed in overlapping stretches; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .sorted_arrays import BASE, BYTE, U, mix, pack, powers, runs, shards_for, text_bytes, unpack

LENGTH, TRIGGER = 100, 32
#: Bytes worked on together, longest stretch of one text, phrases merged before they are sent, distinct phrases of
#: a trigger that go to one shard.
CHUNK, PIECE, BATCH, HOT = 1 << 18, 1 << 20, 1_000_000, 1024
#: Bytes of phrases in one suffix array, whole triggers together.
ARRAY = 4 << 20
_LOW = (1 << 24) - 1
_TOP = np.iinfo(np.uint64).max
#: Kinds of rows that meet in a document's shard.
GONE, ASKED, TEXT = 0, 1, 2
_ANSWER = [np.dtype("u4"), np.dtype("u4")]
_REQUEST = [np.dtype("u4"), np.dtype("u4"), np.dtype("u8"), np.dtype("u1")]
_PARSE = [np.dtype("u8"), np.dtype("u8"), np.dtype("u4"), np.dtype("u4")]


class Phrases:
    """Phrases of a stretch of texts: arrays of trigger hash, phrase hash, text, place of the first
    window in the stretch and number of windows."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
        n = np.maximum(ends - starts - length + 1, 0)
        self.trigger = self.phrase = np.zeros(0, np.uint64)
        self.text = self.at = self.n = np.zeros(0, np.int64)
        if not n.any():
            return
        m = BYTE[data]
        h, p, k = m, BASE, 1
        while k < TRIGGER:
            h, p, k = h[:-k] * U(p) + h[k:], p * p % 2**64, k * 2
        h = mix(h)
        v = (h & ~U(_LOW)) | np.arange(len(h), dtype=np.uint64)
        span, k = length - TRIGGER + 1, 1
        while k * 2 <= span:
            v, k = np.minimum(v[:-k], v[k:]), k * 2
        if span > k:
            v = np.minimum(v[: len(v) - (span - k)], v[span - k :])
        text = np.repeat(np.arange(len(n)), n)
        window = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + starts[text]
        own = (v[window] & U(_LOW)).astype(np.int64)
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])))
        power, inverse = powers(len(data) + 1)
        sums = np.append(U(0), np.cumsum(m * power[: len(m)], dtype=np.uint64))
        self.text, self.at, self.n = text[new], window[new], np.diff(np.append(new, len(own)))
        self.trigger = h[own[new]]
        end = self.at + self.n + length - 1
        shape = (self.n * 1000 + own[new] - self.at).astype(np.uint64)
        self.phrase = mix(mix((sums[end] - sums[self.at]) * inverse[self.at]) * U(5) + shape)


def _pieces(data: np.ndarray, offsets: np.ndarray, a: int, z: int, length: int, piece: int) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
    """Phrases of texts a to z, the texts they come from, and what to add to a place for its place in the
    text. A text longer than ``piece`` is parsed in stretches that share length - 1 bytes, so each window is in one;
    a stretch's edges cut phrases, but not which trigger owns a window."""
    if z - a > 1 or offsets[z] - offsets[a] <= piece:
        begin = offsets[a:z] - offsets[a]
        yield Phrases(data[offsets[a] : offsets[z]], begin, offsets[a + 1 : z + 1] - offsets[a], length), np.arange(a, z), -begin
        return
    size = int(offsets[z] - offsets[a])
    for first in range(0, size - length + 1, piece):
        last = min(size, first + piece + length - 1)
        yield Phrases(data[offsets[a] + first : offsets[a] + last], np.array([0]), np.array([last - first]), length), np.array([a]), np.array([first])


def _order(doc: pa.Array) -> np.ndarray:
    """doc_id as uint64 in the same order."""
    return doc.to_numpy().view(np.uint64) ^ U(1 << 63)


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix(x + U(0x632BE59BD9B4E019)) >> U(64 - shards.bit_length() + 1)).astype(np.int64)


def _dealt(to: np.ndarray, keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(shard, packed rows in order of their keys) of the shards ``to``."""
    order = np.lexsort((keys, to))
    to = to[order]
    edges = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    for a, z in zip(edges, np.append(edges[1:], len(to))):
        part = order[a:z]
        yield int(to[a]), pack(keys[part], [c[part] for c in columns])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["kind", "shard", "blob"])


def _joined(blobs: list[bytes], kinds: list[np.dtype]) -> tuple[np.ndarray, list[np.ndarray]]:
    got = [unpack(b, kinds) for b in blobs]
    if not got:
        return np.zeros(0, np.uint64), [np.zeros(0, k) for k in kinds]
    return np.concatenate([k for k, _ in got]), [np.concatenate(c) for c in zip(*(c for _, c in got))]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ in any key."""
    n = len(keys[0])
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, new)) if n else np.zeros(0, np.int64)


def _later(first: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in groups that start at ``first``: which are not at their group's first place in corpus order, and one
    row of each group that is."""
    if not len(first):
        return np.zeros(0, bool), first
    sizes = np.diff(np.append(first, len(doc)))
    low = np.repeat(np.minimum.reduceat(doc, first), sizes)
    place = np.where(doc == low, at.astype(np.uint64), U(_TOP))
    there = (doc == low) & (place == np.repeat(np.minimum.reduceat(place, first), sizes))
    rows = np.flatnonzero(there)
    which = np.repeat(np.arange(len(first)), sizes)[rows]
    return ~there, rows[np.append(True, which[1:] != which[:-1])]


def suffix_classes(data: np.ndarray, length: int) -> np.ndarray:
    """For each place of data (bytes), the rank of its suffix among all, by its first ``length`` bytes (suffixes at the
    end count as if zeros followed): equal ranks, equal bytes."""
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8))).astype(np.uint64)
    key = np.zeros(len(data) + length, np.uint64)
    for i in range(8):
        key = (key << U(8)) | padded[i : i + len(key)]
    size, rank = 8, _ranks(key)
    while size * 2 <= length:
        rank = _ranks((rank[: len(rank) - size] << U(32)) | rank[size:])
        size *= 2
    if size < length:
        rank = _ranks((rank[: len(rank) - (length - size)] << U(32)) | rank[length - size :])
    return rank[: len(data)]


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(False, ordered[1:] != ordered[:-1]) if len(key) else np.zeros(0, bool)
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _within(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... n[i] of them, for each i."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def _fold(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every ``length`` consecutive bytes of x."""
    out = []
    for table in (BYTE, mix(BYTE + U(77))):
        power, inverse = powers(len(x) + 1)
        sums = np.append(U(0), np.cumsum(table[x] * power[: len(x)], dtype=np.uint64))
        out.append(mix((sums[length:] - sums[:-length]) * inverse[: len(x) - length + 1]))
    return out[0], out[1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("ord"), F.col("text").cast("string").alias("text"))
    shards = shards_for(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ord, text -> parses to the shards of triggers, and what repeats within a batch to the documents' shards,
        which come after those of triggers."""
        held, size = [], 0

        def merged() -> pa.RecordBatch:
            trigger, phrase, doc, at, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((phrase, trigger))
            trigger, phrase, doc, at, n = (x[order] for x in (trigger, phrase, doc, at, n))
            later, one = _later(_groups(trigger, phrase), doc, at)
            out = [(ASKED, x, b) for x, b in _dealt(_shard(trigger[one], shards), trigger[one], [phrase[one], doc[one], at[one], n[one]])]
            return _rows(out + answers(doc[later], at[later], n[later], shards))

        for b in batches:
            data, offsets = text_bytes(b.column(1))
            doc = _order(b.column(0))
            for a, z in runs(offsets, CHUNK):
                for p, texts, add in _pieces(data, offsets, a, z, length, PIECE):
                    if len(p.at):
                        held.append((p.trigger, p.phrase, doc[texts[p.text]], (p.at + add[p.text]).astype(np.uint32), p.n.astype(np.uint32)))
                        size += len(p.at)
                if size >= BATCH:
                    yield merged()
                    held, size = [], 0
        if size:
            yield merged()

    def answers(doc: np.ndarray, at: np.ndarray, n: np.ndarray, first: int = 0) -> list[tuple[int, int, bytes]]:
        """n windows from ``at`` on are repeats: to the documents' shards."""
        return [(GONE, first + x, b) for x, b in _dealt(_shard(doc, shards), doc, [at.astype(np.uint32), (at + n + U(length - 1)).astype(np.uint32)])]

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        """Rows kind, shard, blob in order of shard -> each shard's (kind, blob)."""
        now, held = None, []
        for b in batches:
            for k, x, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if x != now:
                    if held:
                        yield now, held
                    now, held = x, []
                held.append((k, blob.as_buffer()))
        if held:
            yield now, held

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A trigger shard's parses -> which places repeat a phrase, and which phrases are asked for."""
        for x, held in by_shard(batches):
            if x >= shards:  # only on its way to its document
                yield _rows([(GONE, x - shards, bytes(b)) for _, b in held])
                continue
            trigger, (phrase, doc, at, n) = _joined([b for _, b in held], _PARSE)
            order = np.lexsort((phrase, trigger))
            trigger, phrase, doc, at, n = (y[order] for y in (trigger, phrase, doc, at, n))
            later, one = _later(_groups(trigger, phrase), doc, at)
            out = answers(doc[later], at[later], n[later])
            trigger, doc, at, n = (y[one] for y in (trigger, doc, at, n))
            first = _groups(trigger)
            sizes = np.diff(np.append(first, len(trigger)))
            sizes = np.repeat(sizes, sizes)
            ask = sizes > 1
            hot = (sizes > HOT).astype(np.uint8)
            out += [(ASKED, y, b) for y, b in _dealt(_shard(doc[ask], shards), doc[ask], [at[ask], n[ask], trigger[ask], hot[ask]])]
            yield _rows(out)

    wire = "kind int, shard int, blob binary"
    met = rows.select("ord", "text").mapInArrow(parse, wire).repartitionById(2 * shards, "shard").sortWithinPartitions("shard")
    told = settle(met.mapInArrow(triggers, wire), "pfp-parse")

    # texts and what there is for them, by the shard of the document
    placed = _placed(rows, shards)

    def beside(messages: DataFrame) -> DataFrame:
        both = placed.unionByName(messages, allowMissingColumns=True)
        return both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").select("kind", "shard", "blob", "doc_id", "ord", "text")

    def texts(batches: Iterator[pa.RecordBatch], kinds: list[np.dtype]) -> Iterator[tuple]:
        """For each run of texts of a shard: the batch, the texts' bytes, offsets and orders, and the shard's messages
        (ascending orders, columns)."""
        now, held, told_ = None, [], (np.zeros(0, np.uint64), [np.zeros(0, k) for k in kinds])
        for b in batches:
            shard_, kind_ = b.column(1).to_numpy(), b.column(0).to_numpy()
            edges = np.append(_groups(shard_, kind_ == TEXT), len(shard_))
            for a, z in zip(edges[:-1], edges[1:]):
                if shard_[a] != now:
                    now, held, told_ = shard_[a], [], (np.zeros(0, np.uint64), [np.zeros(0, k) for k in kinds])
                part = b.slice(a, z - a)
                if kind_[a] != TEXT:
                    held += [x.as_buffer() for x in part.column(2)]
                    continue
                if held:
                    keys, cols = _joined(held, kinds)
                    order = np.argsort(keys, kind="stable")
                    told_, held = (keys[order], [c[order] for c in cols]), []
                data, offsets = text_bytes(part.column(5))
                yield part, data, offsets, _order(part.column(4)), told_

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts and requests -> phrases to the shards of their triggers, windows of hot ones to all shards."""
        for _, data, offsets, order, (keys, (at, n, trigger, hot)) in texts(batches, _REQUEST):
            a, z = np.searchsorted(keys, order), np.searchsorted(keys, order, side="right")
            which = _within(a, z - a)
            text = np.repeat(np.arange(len(order)), z - a)
            size = np.diff(offsets)[text]
            ok = at[which].astype(np.int64) + n[which] + length - 1 <= size  # a doc_id of two texts asks of both
            which, text = which[ok], text[ok]
            start, count = offsets[text] + at[which], n[which].astype(np.int64)
            doc, out = order[text], []
            cold = np.flatnonzero(hot[which] == 0)
            to = _shard(trigger[which[cold]], shards)
            for x in np.unique(to):
                mine = cold[to == x]
                body = data[_within(start[mine], count[mine] + length - 1)]
                out.append((0, int(x), _phrases(trigger[which[mine]], doc[mine], at[which[mine]], n[which[mine]], body)))
            warm = np.flatnonzero(hot[which])
            for i in range(0, len(warm), 4096):
                mine = warm[i : i + 4096]
                sizes = count[mine] + length - 1
                one, two = _fold(data[_within(start[mine], sizes)], length)
                inside = _within(np.cumsum(sizes) - sizes, count[mine])
                where = _within(at[which[mine]].astype(np.int64), count[mine])
                fp, fq, fd = one[inside], two[inside], np.repeat(doc[mine], count[mine])
                group = np.lexsort((fq, fp))
                fp, fq, fd, where = (y[group] for y in (fp, fq, fd, where))
                later, first = _later(_groups(fp, fq), fd, where)
                out += [(1, x, b) for x, b in _dealt((fp[first] >> U(64 - shards.bit_length() + 1)).astype(np.int64), fp[first], [fq[first], fd[first], where[first].astype(np.uint32)])]
                out += _gone(answers, fd[later], where[later])
            if out:
                yield _rows(out)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's phrases and windows -> which windows are repeats."""
        for _, held in by_shard(batches):
            out = [(GONE, x, b) for k, x, b in ((k, *_addressed(b)) for k, b in held if k == 2)]
            parts = [_unphrases(b) for k, b in held if k == 0]
            if parts:
                trigger, doc, at, n, body = (np.concatenate(y) for y in zip(*parts))
                at, n = at.astype(np.int64), n.astype(np.int64)
                sizes = n + length - 1
                start = np.cumsum(sizes) - sizes
                order = np.argsort(trigger, kind="stable")
                ends = np.append(_groups(trigger[order])[1:], len(order))
                total = np.cumsum(sizes[order])
                i = 0
                while i < len(order):  # whole triggers of about ARRAY bytes
                    far = np.searchsorted(total, (total[i - 1] if i else 0) + ARRAY)
                    j = int(ends[min(np.searchsorted(ends, far + 1), len(ends) - 1)])
                    mine, i = order[i:j], j
                    window = _within(np.cumsum(sizes[mine]) - sizes[mine], n[mine])
                    rank = suffix_classes(body[_within(start[mine], sizes[mine])], length)[window]
                    out += repeats(rank, np.repeat(doc[mine], n[mine]), _within(at[mine], n[mine]))
            keys, (fq, doc, at) = _joined([b for k, b in held if k == 1], [np.dtype("u8"), np.dtype("u8"), np.dtype("u4")])
            if len(keys):
                group = np.lexsort((fq, keys))
                later, _ = _later(_groups(keys[group], fq[group]), doc[group], at[group])
                out += _gone_at(answers, doc[group][later], at[group][later].astype(np.int64))
            yield _rows(out)

    def repeats(rank: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bytes]]:
        order = np.argsort(rank, kind="stable")
        rank, doc, at = rank[order], doc[order], at[order]
        later, _ = _later(_groups(rank), doc, at)
        return _gone_at(answers, doc[later], at[later])

    asked = told.where(F.col("kind") == ASKED)
    made = beside(asked).mapInArrow(cut, wire).repartitionById(shards, "shard").sortWithinPartitions("shard")
    more = settle(made.mapInArrow(suffixes, wire), "pfp-suffixes")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, order, (keys, (at, end)) in texts(batches, _ANSWER):
            a, z = np.searchsorted(keys, order), np.searchsorted(keys, order, side="right")
            which = _within(a, z - a)
            text = np.repeat(np.arange(len(order)), z - a)
            stop = offsets[text + 1]
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, np.minimum(offsets[text] + at[which], stop), 1)
            np.add.at(edge, np.minimum(offsets[text] + end[which], stop), -1)
            gone = np.cumsum(edge[:-1]) > 0
            for i, j in runs(offsets, 1 << 24):
                yield self_rows(part.column(3).slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gone[offsets[i] : offsets[j]])

    def self_rows(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        sums = np.append(0, np.cumsum(gone))
        starts = gone & ~np.append(False, gone[:-1])
        starts[offsets[:-1][offsets[:-1] < len(gone)]] |= gone[offsets[:-1][offsets[:-1] < len(gone)]]
        spans = np.append(0, np.cumsum(starts))
        kept = [data[x:y][~gone[x:y]].tobytes() if sums[y] > sums[x] else data[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
        cols = [ids, pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_text, names + ["kept"] * with_text)

    return beside(told.where(F.col("kind") == GONE).unionByName(more)).mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)



def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """The texts with the shard that _shard gives their order."""

    @F.arrow_udf("int")
    def shard(x: pa.Array) -> pa.Array:
        return pa.array(_shard(_order(x), shards).astype(np.int32))

    return rows.select(F.lit(TEXT).alias("kind"), shard("ord").alias("shard"), F.lit(None).cast("binary").alias("blob"), "doc_id", "ord", "text")


def _gone_at(answers, doc: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Answers for single windows, of which neighbours become one stretch."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if not len(doc):
        return []
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)))
    last = np.append(first[1:], len(at)) - 1
    return answers(doc[first], at[first].astype(np.uint64), (at[last] - at[first] + 1).astype(np.uint64))


def _gone(answers, doc: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The same as rows that pass a trigger shard on their way."""
    return [(2, x, struct.pack("<i", x) + b) for _, x, b in _gone_at(answers, doc, at)]


def _addressed(blob) -> tuple[int, bytes]:
    raw = bytes(blob)
    return struct.unpack_from("<i", raw)[0], raw[4:]


def _phrases(trigger: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, body: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in (trigger, doc, at, n, body))
    return struct.pack("<I", len(doc)) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unphrases(blob) -> tuple[np.ndarray, ...]:
    raw = bytes(blob)
    k = struct.unpack_from("<I", raw)[0]
    raw = zstandard.ZstdDecompressor().decompress(raw[4:])
    longs, ints = np.frombuffer(raw, np.uint64, 2 * k), np.frombuffer(raw, np.uint32, 2 * k, 16 * k)
    return longs[:k], longs[k:], ints[:k], ints[k:], np.frombuffer(raw, np.uint8, -1, 24 * k)
