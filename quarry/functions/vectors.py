"""Vector functions as column expressions over array<float>, and embedders."""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import guards
from .text import tokens

DIMENSIONS = (384, 512, 768, 1024, 1536, 3072)


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_d(v), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 if either is a zero vector; null for unequal lengths."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(n == 0, F.lit(2.0)).otherwise(1 - dot(a, b) / n)


#: Vectors compared at once on either side, and pairs whose exact distances are computed at once.
BLOCK, PAIRS = 1024, 65_536
METRICS = {"l2": l2, "cosine": cosine_distance, "dot": lambda a, b: -dot(a, b), "l1": l1}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once: what is named inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scaled(v: Column) -> Column:
    """An array of doubles at length 1; zero stays zero."""
    pair = let(v, lambda x: F.struct(x.alias("v"), F.sqrt(_sum(F.transform(x, lambda y: y * y))).alias("n")))
    return let(pair, lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(F.lit(0.0)).cast("float")))


def normalize(v: Column) -> Column:
    """v at length 1; null for a zero vector."""
    return F.when(norm(v) > 0, _scaled(_d(v)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: (x + y).cast("float"))


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: (x - y).cast("float"))


def part(v: Column, start: int, end: int) -> Column:
    """Elements start to end - 1."""
    return F.slice(v, start + 1, end - start)


def quantize_int8(v: Column) -> Column:
    """Elements of [-1, 1] as bytes."""
    return F.transform(_d(v), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round(x * 127))).cast("tinyint"))


def quantize_binary(v: Column) -> Column:
    return F.transform(_d(v), lambda x: (x > 0).cast("tinyint"))


def has_dimension(v: Column, n: int) -> Column:
    return v.isNotNull() & (F.size(v) == n)


def from_json_text(c: Column) -> Column:
    """A vector written as "[1, 2, ...]"."""
    return F.from_json(c, "array<float>")


def to_json_text(v: Column) -> Column:
    return F.to_json(v)


def from_blob(c: Column) -> Column:
    """Little-endian float32 bytes as a vector (Arrow UDF: Spark has no such cast)."""

    def udf(blobs: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([None if b is None else np.frombuffer(b, "<f4").tolist() for b in blobs.to_pylist()], pa.list_(pa.float32()))

    return F.arrow_udf(udf, "array<float>")(c)


class Queries:
    """Query vectors and their ids, grouped by size, for a task that looks for their nearest items."""

    def __init__(self, ids: list, rows: list[list[float] | None]):
        sizes: dict[int, list[int]] = {}
        for i, v in enumerate(rows):
            if v and all(x is not None for x in v):
                sizes.setdefault(len(v), []).append(i)
        self.ids = ids
        self.by_size = {n: (np.array(at), np.array([rows[i] for i in at], np.float64)) for n, at in sizes.items()}

    def nearest(self, batches: Iterator[pa.RecordBatch], k: int, metric: str, threshold: float | None) -> Iterator[pa.RecordBatch]:
        """query_id, rowid, distance: of each batch (rowid, embedding) what is among its k nearest, ties included."""
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            lengths = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy()
            starts = vecs.offsets.to_numpy()[:-1]
            flat = vecs.values.to_numpy(zero_copy_only=False)  # null components are nan
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for n, (which, q) in self.by_size.items():
                rows = np.flatnonzero(lengths == n)
                for a in range(0, len(rows), BLOCK):
                    at = rows[a : a + BLOCK]
                    x = flat[starts[at][:, None] + np.arange(n)]
                    ok = np.isfinite(x).all(1)
                    for i in range(0, len(q), BLOCK) if ok.any() else ():
                        qi, j, d = self._block(q[i : i + BLOCK], x[ok], k, metric, threshold)
                        found.append((which[i : i + BLOCK][qi], at[ok][j], d))
            if found:
                qs, js, ds = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array([self.ids[i] for i in qs]), ids.take(pa.array(js)), pa.array(ds)], ["query_id", "rowid", "distance"])

    @staticmethod
    def _block(q: np.ndarray, x: np.ndarray, k: int, metric: str, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rough = _rough(q, x, metric)
        if len(x) > k:
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
            qi, j = np.nonzero(rough <= kth + 1e-6 * (1 + np.abs(kth)))
        else:
            qi, j = (y.ravel() for y in np.indices(rough.shape))
        d = np.concatenate([np.round(_exact(q[qi[i : i + PAIRS]], x[j[i : i + PAIRS]], metric), 9) for i in range(0, len(qi), PAIRS)]) if len(qi) else np.zeros(0)
        if threshold is not None:
            keep = d <= threshold
            qi, j, d = qi[keep], j[keep], d[keep]
        return qi, j, d + 0.0


def _rough(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances [queries, items] that order as the metric does, up to rounding; l2 squared."""
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q])
    dots = q @ x.T
    if metric == "dot":
        return -dots
    a, b = (q * q).sum(1)[:, None], (x * x).sum(1)[None]
    if metric == "l2":
        return a + b - 2 * dots
    size = np.sqrt(a) * np.sqrt(b)
    return np.where(size > 0, 1 - dots / np.where(size > 0, size, 1), 2.0)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        return np.abs(q - x).sum(1)
    if metric == "l2":
        return np.sqrt(((q - x) ** 2).sum(1))
    dots = (q * x).sum(1)
    if metric == "dot":
        return -dots
    size = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1))
    return np.where(size > 0, 1 - dots / np.where(size > 0, size, 1), 2.0)


def hash_embedding(text: Column, n: int = 64) -> Column:
    """Deterministic feature hashing of tokens, at length 1: no model, no Python. Tokens whose signs cancel in every
    place count without signs, so only a text without tokens is zero."""
    toks = tokens(text)
    signed = F.transform(toks, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(n)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    places = lambda ts, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _sum(F.transform(F.filter(ts, lambda x: x["i"] == i), f)))
    raw = lambda ts: let(places(ts, lambda x: x["s"]), lambda v: F.when(F.exists(v, lambda x: x != 0), v).otherwise(places(ts, lambda x: F.lit(1.0))))
    return _scaled(let(signed, raw))


def random_embedding(seed: Column, n: int) -> Column:
    """n numbers in [-1, 1) that follow from seed."""
    unit = lambda i: F.shiftrightunsigned(F.xxhash64(seed, i), 11) * F.lit(2.0**-52) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: unit(i).cast("float"))


class EmbeddingProvider(ABC):
    """Something that turns texts into vectors; it is sent to the workers."""

    dimensions: int = 384
    batch: int = 32

    def initialize(self) -> None:
        """Called once in each task before the first batch."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def healthy(self) -> bool:
        return len(self.embed(["ping"])[0]) == self.dimensions

    def cleanup(self) -> None:
        """Called once in each task after the last batch."""


class RemoteProvider(EmbeddingProvider):
    """A remote service behind ``client`` (texts -> vectors; picklable): calls are spaced by ``per_second``, end after
    ``timeout`` seconds and are repeated with growing delays on retryable errors; ``fallback`` stands in when all fail."""

    def __init__(self, client: Callable[[list[str]], list[list[float]]], dimensions: int = 1536, batch: int = 100, timeout: float = 5.0, retries: int = 3, per_second: float = 50.0, fallback: EmbeddingProvider | None = None, sleep: Callable[[float], None] = time.sleep):
        self.client, self.dimensions, self.batch, self.timeout, self.retries, self.per_second, self.fallback, self.sleep = client, dimensions, batch, timeout, retries, per_second, fallback, sleep
        self.last = 0.0
        self.metrics = {"embeddings": 0, "seconds": 0.0, "mean_seconds": 0.0, "errors": 0, "fallbacks": 0}

    def _ask(self, texts: list[str]) -> list[list[float]]:
        wait = self.last + 1 / self.per_second - time.monotonic()
        if wait > 0:
            self.sleep(wait)
        self.last = time.monotonic()
        pool = ThreadPoolExecutor(1)
        try:
            got = pool.submit(self.client, texts).result(self.timeout)
        finally:
            pool.shutdown(wait=False)
        if len(got) != len(texts) or any(len(v) != self.dimensions for v in got):
            raise ValueError(f"the service answered with vectors of other sizes than {self.dimensions}")
        return got

    def embed(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(1, self.retries + 2):
            began = time.monotonic()
            try:
                got = self._ask(texts)
            except Exception as e:
                self.metrics["errors"] += 1
                if attempt <= self.retries and guards.classify(e).recoverable:
                    self.sleep(min(2.0 ** (attempt - 1), 30.0))
                    continue
                if self.fallback is None:
                    raise
                self.metrics["fallbacks"] += 1
                return self.fallback.embed(texts)
            m = self.metrics  # the mean is that of all embeddings so far
            m["embeddings"] += len(texts)
            m["seconds"] += time.monotonic() - began
            m["mean_seconds"] = m["seconds"] / m["embeddings"]
            return got
        raise AssertionError


class Registry:
    """Providers by name, made when first asked for and let go when idle for ``idle`` seconds."""

    def __init__(self, idle: float = 1800.0, clock: Callable[[], float] = time.monotonic):
        self.idle, self.clock, self.makers, self.live = idle, clock, {}, {}

    def register(self, name: str, make: Callable[[], EmbeddingProvider], preload: bool = False) -> None:
        self.makers[name] = make
        if preload:
            self.get(name)

    def get(self, name: str) -> EmbeddingProvider:
        self.evict()
        if name not in self.live:
            provider = self.makers[name]()
            provider.initialize()
            self.live[name] = [provider, 0.0, 0]
        entry = self.live[name]
        entry[1], entry[2] = self.clock(), entry[2] + 1
        return entry[0]

    def evict(self) -> list[str]:
        """Let idle providers go; their names."""
        gone = [n for n, (_, used, _) in self.live.items() if self.clock() - used > self.idle]
        for n in gone:
            self.live.pop(n)[0].cleanup()
        return gone

    def most_used(self, n: int = 5) -> list[str]:
        return sorted(self.live, key=lambda x: (-self.live[x][2], x))[:n]


class HashProvider(EmbeddingProvider):
    """The hash embedder for callers that need a provider."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import math
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed(df: DataFrame, provider: EmbeddingProvider, text: str = "text", into: str = "embedding") -> DataFrame:
    """df with the provider's vector of each text. A text whose batch fails gets null and the batch's others
    are tried one by one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider.initialize()
        try:
            for b in batches:
                texts = [t or "" for t in b.to_pylist()]
                out: list = []
                for i in range(0, len(texts), provider.batch):
                    part = texts[i : i + provider.batch]
                    try:
                        out += provider.embed(part)
                    except Exception:  # a remote provider may refuse one text of many
                        for t in part:
                            try:
                                out += provider.embed([t])
                            except Exception:
                                out.append(None)
                yield pa.array(out, pa.list_(pa.float32()))
        finally:
            provider.cleanup()

    return df.withColumn(into, F.arrow_udf(run, "array<float>")(F.col(text).cast("string")))


def embed_missing(docs: DataFrame, cache: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """Vectors of docs (id, text): from cache (key, embedding) by content, else from the provider.
    Columns id, key, embedding, cached."""
    keyed = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = keyed.join(cache.select("key", "embedding").dropDuplicates(["key"]), "key").select("id", "key", "embedding", F.lit(True).alias("cached"))
    missing = keyed.join(cache, "key", "left_anti")
    made = embed(missing.select("key", "text").dropDuplicates(["key"]), provider).select("key", "embedding")
    fresh = missing.join(made, "key").select("id", "key", "embedding", F.lit(False).alias("cached"))
    return known.unionByName(fresh)


def parse_vector(text: str) -> list[float]:
    v = json.loads(text)
    if not isinstance(v, list) or not all(isinstance(x, (int, float)) for x in v):
        raise ValueError("a vector is a JSON array of numbers")
    return [float(x) for x in v]
