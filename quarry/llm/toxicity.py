"""Toxicity with noisy-channel deobfuscation.

Every text is restored: stretches that look disguised (symbols or digits inside a word, letters
spaced out one by one, letters repeated), of any length, become a lattice of what each character
may stand for, and a Viterbi pass under a character trigram model picks the likeliest reading,
which replaces the stretch. The lattice of any other word has one path, the word itself. What
is scored is the restored text and nothing else: by the words that labelled toxic texts favour
once they are restored, through a logistic fit.

The character model, the words and the fit come from all labelled rows, restored and counted in
Spark. All their trigrams, which grow with the alphabets, and all words that pass the test pass the
driver. Evidence is an Arrow UDF over whole texts, with no shuffle; a registered run computes it
once a document, writes it, and fits on what the labelled ones have.

Defined cases: a null or empty text has no words and gets the score of such texts; a
document with several labels trains with each; labels without a document, or null, are
ignored; without labels of both kinds every score is the share of label 1 (or 0);
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: What a character may stand for besides itself (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e"}
#: Tokens and readings that a task remembers, and how long they may be; others are read anew.
MEMORY, KEPT = 200_000, 100
#: Labels that are broadcast at once.
BROADCAST = 2_000_000
_WORD = re.compile(r"[^\W\d_]+")
#: Where a disguise may be: a letter beside a symbol or digit, or three times.
_HARD = re.compile(r"[^\W\d_][\d@$!|+(*#€]|[\d@$!|+(*#€][^\W\d_]|([^\W\d_])\1\1")
#: The stretch around it.
_MIXED = re.compile(r"(?:(?!_)[\w@$!|+(*#€])+")
#: Single characters with one separator between them.
_SPACED = re.compile(r"(?<![^\W_])(?!_)[\w@$!|+(*#€]([ .\-_*~])(?!_)[\w@$!|+(*#€](?:\1(?!_)[\w@$!|+(*#€])+(?![^\W_])")
_TOKEN = re.compile(r"\S+")
#: Marks an output that is no part of a word: the word before it ends.
BREAK = "\0"


class CharModel:
    """Character trigrams with bigram and unigram backing, words bounded by spaces."""

    def __init__(self, tri: dict[str, float]):
        self.tri, self.bi, self.uni = tri, Counter(), Counter()
        self.ctx, self.ctx1 = Counter(), Counter()
        for g, n in tri.items():
            self.bi[g[1:]] += n
            self.uni[g[2]] += n
            self.ctx[g[:2]] += n
            self.ctx1[g[1]] += n
        self.all = max(1.0, sum(self.uni.values()))
        self.logs: dict[str, float] = {}

    def logp(self, a: str, b: str, c: str) -> float:
        p = (self.uni.get(c, 0) + 0.1) / (self.all + 50)
        p = (self.bi.get(b + c, 0) + 8 * p) / (self.ctx1.get(b, 0) + 8)
        return math.log((self.tri.get(a + b + c, 0) + 4 * p) / (self.ctx.get(a + b, 0) + 4))

    def decode(self, lattice: list[list[tuple[str, float]]]) -> tuple[str, float]:
        """Likeliest string and its log probability; each place has (output, cost) choices."""
        logs, logp = self.logs, self.logp
        if len(logs) > MEMORY:
            logs.clear()
        best: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
        for place in lattice:
            after: dict[str, tuple[float, tuple]] = {}
            for state, (v, path) in best.items():
                for out, cost in place:
                    s, w = state, v - cost
                    for c in " " if out[:1] == BREAK else out:
                        if c != " " or s != "  ":
                            g = s + c
                            p = logs.get(g)
                            if p is None:
                                p = logs[g] = logp(s[0], s[1], c)
                            w += p
                        s = s[1] + c
                    if out[:1] == BREAK:
                        s = "  "
                    if s not in after or w > after[s][0]:
                        after[s] = (w, (path, out))
            best = after
        v, path = max((v + (self.logp(s[0], s[1], " ") if s != "  " else 0.0), path) for s, (v, path) in best.items())
        parts = []
        while path:
            path, out = path
            parts.append(out.removeprefix(BREAK))
        return "".join(reversed(parts)), v


def lattice(s: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Choices for each run of equal characters of s: itself, what it stands for, and fewer of it.

    Symbols and digits may also be no part of the word, which costs less for symbols around a word in one piece.
    """
    out = []
    letters = [i for i, c in enumerate(s) if c.isalpha()]
    for m in re.finditer(r"(.)\1*", s, re.DOTALL):
        c, n = m[1], len(m[0])
        reads = [(c, 0.0)] if c.isalpha() else []
        reads += [(x, 0.7 + 0.5 * (len(LEET[c]) > 1)) for x in LEET.get(c, "")]
        place = []
        for x, cost in reads:
            place += [(x, cost)] if n == 1 else [(x, cost + 6.0), (x + x, cost)] if n == 2 else [(x, cost + 0.4), (x + x, cost + 0.8)]
        if not c.isalpha():
            inner = letters and letters[0] < m.start() < letters[-1]
            place.append((BREAK + m[0], 4.0 if inner or spaced or c.isdigit() else 2.0))
        out.append(place)
        if spaced:
            out.append([("", 0.0), (" ", 3.0)])
    return out


class Restorer:
    """Reads disguises; remembers what tokens, which texts repeat, come to."""

    def __init__(self, model: CharModel, terms: Iterable[str] = ()):
        self.model, self.terms = model, frozenset(terms)
        self.kept: dict[str, frozenset[str]] = {}
        self.kept_words: dict[str, tuple[str, ...]] = {}
        self._kept_read = lru_cache(MEMORY)(self._read)

    def _read(self, s: str, spaced: bool) -> str:
        return self.model.decode(lattice(s, spaced))[0]

    def read(self, s: str, spaced: bool) -> str:
        return (self._kept_read if len(s) <= KEPT else self._read)(s, spaced)

    def spaced(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, reading) of the words of a lower-case text that are spelt with separators."""
        for m in _SPACED.finditer(text):
            x = m[0][::2]
            if any(c.isalpha() for c in x):
                yield m.start(), m.end(), self.read(x, True)

    def mixed(self, token: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, reading) of the stretches of a lower-case token that hold symbols, digits or repeated letters."""
        if _HARD.search(token):
            for x in _MIXED.finditer(token):
                if _HARD.search(x[0]):
                    yield x.start(), x.end(), self.read(x[0], False)

    def found(self, text: str) -> set[str]:
        """The terms among the words of the restored text."""
        out = set()
        for token in set(self.joined(text).split()):
            got = self.kept.get(token)
            if got is None:
                got = self.terms & words(self.token(token))
                if len(token) <= KEPT:
                    if len(self.kept) >= MEMORY:
                        self.kept.clear()
                    self.kept[token] = got
            if got:
                out |= got
        return out

    def words(self, text: str) -> set[str]:
        """The words of the restored text."""
        out: set[str] = set()
        for token in set(self.joined(text).split()):
            got = self.kept_words.get(token)
            if got is None:
                got = tuple(words(self.token(token)))
                if len(token) <= KEPT:
                    if len(self.kept_words) >= MEMORY:
                        self.kept_words.clear()
                    self.kept_words[token] = got
            out.update(got)
        return out

    def joined(self, text: str) -> str:
        """text in lower case with the words that are spelt with separators read."""
        return _replaced(text.lower(), self.spaced)

    def token(self, token: str) -> str:
        return _replaced(token, self.mixed)

    def restore(self, text: str) -> str:
        """text in lower case with its disguised stretches read."""
        return _TOKEN.sub(lambda m: self.token(m[0]), self.joined(text))


def _replaced(text: str, stretches) -> str:
    parts, at = [], 0
    for a, z, reading in stretches(text):
        parts += [text[at:a], reading]
        at = z
    return "".join(parts) + text[at:] if parts else text


def words(text: str) -> set[str]:
    return set(_WORD.findall(text))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> gram, n: character trigrams of the words of texts as they are, a word counted once a text."""
    for b in batches:
        got: Counter = Counter()
        tri: Counter = Counter()
        for text in b.column(0).to_pylist():
            got.update(words(text.lower()))
        for w, n in got.items():
            for g in grams(w):
                tri[g] += n
        yield pa.RecordBatch.from_arrays([pa.array(tri.keys(), pa.string()), pa.array(tri.values(), pa.int64())], ["gram", "n"])


def grams(word: str) -> list[str]:
    x = f"  {word} "
    return [x[i : i + 3] for i in range(len(x) - 2)]


def _words(model: CharModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """label, text -> word, n1, n0: texts of each label that hold the word once restored."""
        restorer = Restorer(model)
        for b in batches:
            got: tuple[Counter, Counter] = Counter(), Counter()
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[label].update(restorer.words(text))
            keys = list(got[0].keys() | got[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([got[y][w] for w in keys], pa.int64()) for y in (1, 0))], ["word", "n1", "n0"])

    return run


class Model:
    def __init__(self, chars: CharModel, terms: dict[str, float] | None, a: float, b: float):
        self.chars, self.terms, self.a, self.b = chars, terms, a, b

    def evidence(self, restorer: Restorer, text: str | None) -> float:
        """Sum of the terms' weights over the distinct words of the restored text."""
        if not text:
            return 0.0
        return min(12.0, sum(self.terms[w] for w in sorted(restorer.found(text))))

    def score(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.a + self.b * x)))


def _fit(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Logistic a + b x over (x, weight of label 1, weight of label 0), b not negative."""
    a = b = 0.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, w1, w0 in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            n, r = w1 + w0, w1 - (w1 + w0) * p
            g0, g1, q = g0 + r, g1 + r * x, n * p * (1 - p)
            h00, h01, h11 = h00 + q, h01 + q * x, h11 + q * x * x
        g1, h00, h11 = g1 - 1e-2 * b, h00 + 1e-6, h11 + 1e-2
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = max(-20.0, min(20.0, a + max(-2.0, min(2.0, da)))), max(0.0, min(20.0, b + max(-2.0, min(2.0, db))))
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def _usable(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))


def _labelled(docs: DataFrame, y: DataFrame) -> DataFrame:
    """docs joined with all of y by doc_id: y is broadcast in sets, texts are not shuffled."""
    n = -(-y.count() // BROADCAST)
    sets = [y] if n < 2 else [y.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == i) for i in range(n)]
    return reduce(DataFrame.union, (docs.join(F.broadcast(s), "doc_id") for s in sets))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id and toxic, already without the held-out ones. All their documents train."""
    model, texts = _learn(docs, labels)
    return _fitted(model, texts.select("label", evidence_udf(docs.sparkSession, model)("text").alias("evidence"))) if model.terms is not None else _constant(texts)


def _learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The characters and terms of a model (no terms, None, if not both labels are there), and label and text of what trains."""
    texts = settle(_labelled(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), _usable(labels)).select("label", "text"), "toxic-labelled")
    sizes = {r.label: float(r["count"]) for r in texts.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(CharModel({}), None, 0.0, 0.0), texts
    n1, n0 = sizes[1], sizes[0]
    tri = {r.gram: float(r.n) for r in texts.select("text").mapInArrow(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").collect()}
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + 0.5) / (n0 + 1)
    odds = F.log(p1) - F.log(p0)
    # log-likelihood ratio of the word's split between the labels: sound for rare words too
    n, total = F.col("n1") + F.col("n0"), n1 + n0
    g = 2 * (F.col("n1") * F.ln(F.col("n1") * total / (n * n1)) + F.when(F.col("n0") > 0, F.col("n0") * F.ln(F.col("n0") * total / (n * n0))).otherwise(F.lit(0.0)))
    seen = texts.mapInArrow(_words(CharModel(tri)), "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    terms = seen.where(F.col("n1") >= 3).select("word", odds.alias("odds"), g.alias("g")).where((F.col("g") > 15) & (F.col("odds") > 0.7)).orderBy(F.desc("g"), "word").collect()
    lift = 0.002 * sum(tri.values()) / max(1, len(terms))  # words that labels favour are likelier behind a disguise
    for r in terms:
        for x in grams(r.word):
            tri[x] = tri.get(x, 0.0) + lift
    return Model(CharModel(tri), {r.word: float(min(r.odds, 6.0)) for r in terms}, 0.0, 1.0), texts


def _constant(texts: DataFrame) -> Model:
    """Of labels of one kind, or none."""
    return Model(CharModel({}), {}, 20.0 if texts.where("label = 1").limit(1).count() else -20.0, 0.0)


def _fitted(model: Model, evidence: DataFrame) -> Model:
    """The model with its fit to evidence: a label and an evidence for each row that trains."""
    bins: dict[float, list[float]] = {}
    for r in evidence.groupBy("label", F.round("evidence", 1).alias("x")).count().collect():
        bins.setdefault(r.x, [0.0, 0.0])[0 if r.label == 1 else 1] += r["count"]
    model.a, model.b = _fit([(k, *v) for k, v in sorted(bins.items())])
    return model


def evidence_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        restorer = Restorer(m.chars, m.terms)
        for texts in batches:
            yield pa.array([m.evidence(restorer, t) for t in texts.to_pylist()], pa.float64())

    return udf


def restore_udf(spark, model: Model):
    """The restored texts themselves."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = Restorer(shared.value.chars)
        for texts in batches:
            yield pa.array([None if t is None else restorer.restore(t) for t in texts.to_pylist()], pa.string())

    return udf


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence."""
    out_of = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = lambda m: docs.select("doc_id", out_of().alias("held_out"), evidence_udf(docs.sparkSession, m)(F.col("text").cast("string")).alias("evidence"))
    if model is None:
        labels = labels.where(~out_of())
        model, texts = _learn(docs, labels)
        if model.terms is None:
            model = _constant(texts)
            out = rows(model)
        else:
            out = settle(rows(model), "toxic-evidence")
            model = _fitted(model, _labelled(out.select("doc_id", "evidence"), _usable(labels)))
    else:
        out = rows(model)
    s = 1 / (1 + F.exp(-(F.lit(model.a) + F.lit(model.b) * F.col("evidence"))))
    return out.select("doc_id", "held_out", s.alias("score"), "evidence").select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
