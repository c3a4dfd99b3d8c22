"""Sorted hash arrays: built by a distributed merge, kept in the shared folder, memory-mapped by workers.

Map tasks send a shard's keys (already merged within the task's batch) as one packed blob, so
a hot key costs one entry a batch; each shard's blobs are merged in key order and written as
arrays. Shards are ranges of the hash, as many as the corpus needs (``shards_for``), so a
merge holds a bounded part of the keys. Files are written whole and renamed; a repeated task
writes the same bytes.

A file holds the keys in order without the bits that their place implies: a table of the places
of 2 ** b ranges of the shard's hashes leaves 40 bits, five bytes, of each key (all eight where
the table would cost more). Each column is stored in the smallest of three forms: plain, one byte
with a list of what doesn't fit, or a default with a list of what differs.

Lookups go through whole batches in key order, so each shard is visited once a batch and read
front to back; a worker keeps at most ``OPEN`` shards mapped.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import fresh_path, local_path, read_bytes, settle, write_bytes

U = np.uint64
#: Bytes of corpus for each shard.
SHARD_BYTES = 8 << 20
#: Shards that a worker keeps mapped, or (where the folder isn't mounted) fetched.
OPEN, FETCHED = 512, 4
_rng = np.random.Generator(np.random.PCG64(20240117))
#: A random 64-bit number for each byte, and an odd multiplier with its inverse.
BYTE = _rng.integers(0, 2**64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_POWERS = {0: (np.ones(1, np.uint64), np.ones(1, np.uint64))}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i up to n, mod 2**64."""
    if len(_POWERS[0][0]) <= n:
        size = max(n + 1, 1 << 18)
        _POWERS[0] = tuple(np.append(U(1), np.cumprod(np.full(size, U(b), np.uint64))) for b in (BASE, INVERSE))
    return _POWERS[0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its len + 1 offsets; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Whole texts of about ``size`` bytes together: first and one past the last."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, min(n, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1))
        yield a, z
        a = z


def shards_for(n_bytes: int, most: int = 1 << 16) -> int:
    """A power of two."""
    n = 8
    while n < most and n * SHARD_BYTES < n_bytes:
        n *= 2
    return n


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def pack(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Ascending keys and columns, compressed."""
    parts = [_planes(np.diff(keys, prepend=U(0))), *(_planes(c) for c in columns)]
    return struct.pack("<I", len(keys)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, kinds: list[np.dtype]) -> tuple[np.ndarray, list[np.ndarray]]:
    n = struct.unpack_from("<I", blob)[0]
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob[4:]), 0, []
    for kind in [np.dtype(np.uint64), *kinds]:
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return np.cumsum(out[0], dtype=np.uint64), out[1:]


def split(keys: np.ndarray, columns: list[np.ndarray], n_shards: int) -> pa.RecordBatch:
    """shard, blob for ascending keys."""
    shift = U(64 - n_shards.bit_length() + 1)
    edges = np.searchsorted(keys, np.arange(n_shards, dtype=np.uint64) << shift)
    edges = np.append(edges, len(keys))
    have = np.flatnonzero(np.diff(edges))
    blobs = [pack(keys[edges[i] : edges[i + 1]], [c[edges[i] : edges[i + 1]] for c in columns]) for i in have]
    return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])


def sum_by_key(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]


def merge(messages: DataFrame, kinds: list[str], n_shards: int, finish: Callable, result: str, name: str) -> tuple[str, DataFrame]:
    """Merge messages (shard, blob) by shard. finish(keys, columns) gets a shard's rows, unordered, and
    gives (ascending keys, columns to store, a tuple for the result row of the shard); result is
    its schema. Returns the arrays' path and the (written) result rows."""
    path = fresh_path(messages.sparkSession, name)
    types = [np.dtype(k) for k in kinds]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, cols = None, [], []

        def close() -> tuple:
            k = np.concatenate(keys)
            c = [np.concatenate(x) for x in zip(*cols)] if types else []
            k, stored, row = finish(k, c)
            write_bytes(f"{path}/{now:05d}.bin", _file(k, stored, n_shards))
            return row

        rows = []
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if shard != now:
                    if now is not None:
                        rows.append(close())
                    now, keys, cols = shard, [], []
                k, c = unpack(blob.as_buffer(), types)
                keys.append(k)
                cols.append(c)
        if now is not None:
            rows.append(close())
        schema = out_schema
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(result))
    # a shard is a task's work
    done = messages.repartitionById(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(task, result)
    return path, settle(done, f"{name}-rows")


def _bits(n_shards: int) -> int:
    return n_shards.bit_length() - 1


def _file(keys: np.ndarray, columns: list[np.ndarray], n_shards: int) -> bytes:
    """keys ascending, of one shard."""
    n, top = len(keys), _bits(n_shards)
    b = max(24 - top, n.bit_length() - 3)
    parts: list[np.ndarray] = []
    if (4 << b) + 5 * n < 8 * n:
        mask = U((1 << (64 - top)) - 1)
        ranges = (keys & mask) >> U(64 - top - b)
        table = np.searchsorted(ranges, np.arange((1 << b) + 1, dtype=np.uint64)).astype(np.uint32)
        parts += [table, (keys & U(0xFFFFFFFF)).astype(np.uint32), (keys >> U(32) & U(0xFF)).astype(np.uint8)]
    else:
        b = 0
        parts.append(keys)
    forms = []
    for c in columns:
        form, arrays = _column(c)
        forms.append((form, c.dtype.str, len(parts)))
        parts += arrays
    places, at = [], 0
    for x in parts:
        places.append((x.dtype.str, len(x), at))
        at += -(-x.nbytes // 8) * 8
    head = json.dumps({"n": n, "b": b, "columns": forms, "parts": places}).encode()
    head += b" " * (-(len(head) + 4) % 8)
    return b"".join([struct.pack("<I", len(head)), head, *(y for x in parts for y in (x.tobytes(), bytes(-x.nbytes % 8)))])


def _column(c: np.ndarray) -> tuple[str, list[np.ndarray]]:
    """The smallest form of a column, and its arrays."""
    sizes, made = {"plain": c.nbytes}, {"plain": [c]}
    if len(c) and c.dtype.kind == "u" and c.dtype.itemsize > 1:
        far = np.flatnonzero(c >= 255)
        sizes["byte"] = len(c) + len(far) * (4 + c.itemsize)
        made["byte"] = [np.minimum(c, 255).astype(np.uint8), far.astype(np.uint32), c[far]]
    if len(c):
        values, counts = np.unique(c[:: max(1, len(c) // 1000)], return_counts=True)
        usual = values[counts.argmax() : counts.argmax() + 1]
        far = np.flatnonzero(c != usual[0])
        sizes["usual"] = len(far) * (4 + c.itemsize)
        made["usual"] = [usual, far.astype(np.uint32), c[far]]
    form = min(sizes, key=sizes.get)
    return form, made[form]


class _Shard:
    def __init__(self, raw: np.ndarray, n_shards: int):
        size = struct.unpack_from("<I", raw[:4].tobytes())[0]
        head = json.loads(raw[4 : 4 + size].tobytes())
        self.n, self.b, self.top, self.columns = head["n"], head["b"], _bits(n_shards), head["columns"]
        base = 4 + size
        self.parts = [raw[base + at : base + at + k * np.dtype(t).itemsize].view(t) for t, k, at in head["parts"]]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1; keys ascending."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        if not self.b:
            have = self.parts[0]
            at = np.minimum(np.searchsorted(have, keys), self.n - 1)
            ok = have[at] == keys
            out[ok] = at[ok]
            return out
        table, low, high = self.parts[:3]
        r = ((keys & U((1 << (64 - self.top)) - 1)) >> U(64 - self.top - self.b)).astype(np.int64)
        at, end = table[r].astype(np.int64), table[r + 1].astype(np.int64)
        want, more = (keys & U(0xFFFFFFFF)).astype(np.uint32), (keys >> U(32) & U(0xFF)).astype(np.uint8)
        live = np.flatnonzero(at < end)
        while len(live):  # a few keys a range
            p = at[live]
            got = low[p]
            ok = got == want[live]
            ok[ok] = high[p[ok]] == more[live[ok]]
            out[live[ok]] = p[ok]
            live = live[~ok]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def values(self, i: int, at: np.ndarray) -> np.ndarray:
        """Column i at ascending places."""
        form, kind, first = self.columns[i]
        if form == "plain":
            return self.parts[first][at]
        usual, far, other = self.parts[first : first + 3]
        out = usual[at].astype(kind) if form == "byte" else np.full(len(at), usual[0], kind)
        if len(far):
            j = np.minimum(np.searchsorted(far, at), len(far) - 1)
            there = far[j] == at
            out[there] = other[j[there]]
        return out


class Arrays:
    """Reader of merge()'s arrays. Shards are mapped where the shared folder is mounted, else fetched."""

    def __init__(self, path: str, n_shards: int):
        self.path, self.n_shards, self.open = path, n_shards, {}

    def __getstate__(self) -> dict:
        return {"path": self.path, "n_shards": self.n_shards, "open": {}}

    def shard(self, i: int) -> _Shard | None:
        if i in self.open:
            return self.open[i]
        name = f"{self.path}/{i:05d}.bin"
        p = local_path(name)
        while len(self.open) >= (OPEN if p is not None else FETCHED):
            self.open.pop(next(iter(self.open)))
        try:
            raw = np.memmap(p, np.uint8, "r") if p is not None else np.frombuffer(read_bytes(name), np.uint8)
        except FileNotFoundError:  # no key fell into it
            self.open[i] = None
        else:
            self.open[i] = _Shard(raw, self.n_shards)
        return self.open[i]

    def find(self, keys: np.ndarray, kinds: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each key: whether it is there, and its columns (0 where it isn't)."""
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        once = keys[new]
        shift = U(64 - _bits(self.n_shards))
        edges = np.append(np.searchsorted(once, np.arange(self.n_shards, dtype=np.uint64) << shift), len(once))
        there = np.zeros(len(once), bool)
        cols = [np.zeros(len(once), k) for k in kinds]
        for i in np.flatnonzero(np.diff(edges)):
            a, z = edges[i], edges[i + 1]
            have = self.shard(int(i))
            if have is None:
                continue
            at = have.places(once[a:z])
            ok = at >= 0
            there[a:z] = ok
            at = at[ok]
            for j, c in enumerate(cols):
                c[a:z][ok] = have.values(j, at)
        which = np.cumsum(new) - 1
        back = np.empty(len(order), np.int64)
        back[order] = which
        return there[back], [c[back] for c in cols]
