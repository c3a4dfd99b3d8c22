"""Language identification of mixed-language text.

A word's script (by Unicode range) narrows its candidate languages to those that used the
script in training; only they are scored: character trigrams within the word give each
candidate a log probability, and the others rank ``FAR`` below the worst candidate. A Viterbi pass
over the words, with a fixed penalty for each switch, labels spans. A text's language is that of
most of its letters, its share theirs of all letters. The score is the share times the certainty that
it is this language rather than the next best, 1 - exp(-margin of their log probabilities).

``fit`` tells how a text resembles its language: how far its mean log probability a letter is from
that of the training texts, in standard deviations of a letter's; times n / (n + 200) for n letters,
so that short texts, which may be all names or numbers, are near 0.

Trigram counts are gathered in Spark from a bounded, hash-chosen sample of the labelled rows
(``max_docs`` for each language), hashed into a fixed number of buckets, so the model's size
depends on the number of languages only (at most ``max_langs``). Prediction is one Arrow UDF
over whole texts: no shuffle, so hot sources and groups of copies cost only their own rows.

A text whose best excursion from its overall language gains less than the penalty can't
switch at all (shown at ``_one_language``); only other texts run the Viterbi loop.

Defined cases: null texts and texts without a letter are ``und`` with score 0; if nothing was
learned every text is ``und``; ties go to the language first in code point order; repeated
rows each give a row; an empty table an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

BUCKETS = 1 << 16
#: Unicode ranges of scripts (fixed values): first and last code point, script.
SCRIPTS = [
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xFF21, 0xFF5A, 1),
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2), (0x0400, 0x052F, 3), (0x1C80, 0x1C8F, 3),
    (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5), (0x0600, 0x077F, 6), (0x08A0, 0x08FF, 6),
    (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0A00, 0x0DFF, 9), (0x0E00, 0x0E7F, 10),
    (0x0E80, 0x0FFF, 11), (0x10A0, 0x10FF, 12), (0x1100, 0x11FF, 13), (0xAC00, 0xD7AF, 13),
    (0x3040, 0x30FF, 14), (0x3400, 0x4DBF, 15), (0x4E00, 0x9FFF, 15), (0x20000, 0x3FFFF, 15),
]
N_SCRIPTS = 16
FAR = 50.0
RESULT = "struct<lang_pred:string,score:double,share:double,fit:double,spans:array<struct<lang:string,first_word:int,n_words:int>>>"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its script (0: none of SCRIPTS)."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for first, last, s in SCRIPTS:
        script[first : last + 1] = s
    return letter, script


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in one array: trigram bucket and word number of each letter, each word's
    script, letters and text, and the first word of each text."""
    letter, script = _tables()
    joined = "\n" + "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), np.uint32)
    if len(cp) != len(joined):  # lower() may lengthen a few characters; texts must keep their places
        cp = np.frombuffer(("\n" + "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(t.lower()) for t in texts])
    else:
        sizes = np.array([len(t) for t in texts])
    is_letter = letter[cp]
    flat = np.where(is_letter, cp, 32).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    h = flat[at - 1] * np.uint32(0x9E3779B1) ^ flat[at] * np.uint32(0x85EBCA6B) ^ flat[at + 1] * np.uint32(0xC2B2AE35)
    bucket = ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    starts = np.flatnonzero(is_letter[at] & ~is_letter[at - 1])  # indexes into at
    letters = np.diff(np.append(starts, len(at)))
    begins = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))  # of texts in cp; one more at the end
    text_first = np.searchsorted(at[starts], begins)
    return bucket, starts, script[flat[at[starts]]], letters, np.repeat(np.arange(len(texts)), np.diff(text_first)), text_first


def _chunks(texts: list[str | None], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of texts of about ``size`` characters together, without nulls."""
    which, run, n = [], [], 0
    for i, t in enumerate(texts):
        if t:
            which.append(i)
            run.append(t)
            n += len(t)
            if n >= size:
                yield which, run
                which, run, n = [], [], 0
    if run:
        yield which, run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[str, np.ndarray] = {}
        langs = b.column(0).to_pylist()
        for which, run in _chunks(b.column(1).to_pylist(), 1 << 21):
            bucket, starts, scripts, letters, text, _ = _words(run)
            if not len(bucket):
                continue
            word = np.repeat(np.arange(len(starts)), letters)
            of = text[word]
            names = [langs[i] for i in which]
            for lang in set(names):
                mine = np.array([x == lang for x in names])
                got = np.bincount(bucket[mine[of]], minlength=BUCKETS)
                got = np.append(got, np.bincount(scripts[mine[text]], weights=letters[mine[text]], minlength=N_SCRIPTS).astype(np.int64))
                sums[lang] = sums.get(lang, 0) + got
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], ["lang", "feature", "n"])


class Model:
    """langs in code point order; logp float32 [BUCKETS, langs]; allowed bool [scripts, langs]."""

    def __init__(self, langs: list[str], counts: np.ndarray, penalty: float = 12.0, alpha: float = 0.2):
        self.langs, self.penalty = langs, penalty
        self.mean, self.spread = np.zeros(len(langs)), np.ones(len(langs))
        grams = counts[:, :BUCKETS].astype(np.float64) + alpha
        self.logp = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32).T.copy() if langs else np.zeros((BUCKETS, 0), np.float32)
        scripts = counts[:, BUCKETS:].astype(np.float64).T
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        self.allowed = share >= 0.005
        self.allowed[~self.allowed.any(1)] = True
        if langs:  # of a letter's log probability under its own language
            p = grams / grams.sum(1, keepdims=True)
            own = np.log(p)
            self.mean = (p * own).sum(1)
            self.spread = np.sqrt(np.maximum((p * own**2).sum(1) - self.mean**2, 1e-9))

    def word_scores(self, bucket: np.ndarray, starts: np.ndarray, scripts: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """[words, languages]: log probabilities of the candidates that each word's script leaves."""
        score = np.full((len(starts), len(self.langs)), np.nan)
        for k in range(len(self.langs)):
            mine = self.allowed[scripts, k]
            if mine.all():
                score[:, k] = np.add.reduceat(self.logp[bucket, k], starts, dtype=np.float64)
            elif mine.any():
                part, sizes = bucket[np.repeat(mine, letters)], letters[mine]
                score[mine, k] = np.add.reduceat(self.logp[part, k], np.cumsum(sizes) - sizes, dtype=np.float64)
        narrowed = np.isnan(score)
        if narrowed.any():
            score = np.where(narrowed, np.nanmin(score, axis=1, keepdims=True) - FAR, score)
        return score

    def label(self, texts: list[str]) -> list[tuple[str, float, float, float, list[tuple[str, int, int]]]]:
        """(language, score, share, fit, spans) of each text."""
        n_langs = len(self.langs)
        none = ("und", 0.0, 0.0, 0.0, [])
        bucket, starts, scripts, letters, text, first = _words(texts)
        if not n_langs or not len(starts):
            return [none] * len(texts)
        score = self.word_scores(bucket, starts, scripts, letters)
        has = np.flatnonzero(np.diff(first))
        total = np.add.reduceat(score, first[has], axis=0)
        size = np.add.reduceat(letters, first[has]).astype(np.float64)
        best = total.argmax(1)
        rest = total.copy()
        rest[np.arange(len(has)), best] = -np.inf
        margin = total.max(1) - rest.max(1) if n_langs > 1 else np.full(len(has), 50.0)
        single = self._one_language(score, first, has, best)
        out = [none] * len(texts)
        for j, i in enumerate(has.tolist()):
            a, b = int(first[i]), int(first[i + 1])
            sure = 1.0 - float(np.exp(-min(50.0, margin[j])))
            if single[j]:
                k = best[j]
                out[i] = (self.langs[k], sure, 1.0, self._fit(total[j, k], size[j], k), [(self.langs[k], 0, b - a)])
            else:
                k, share, inside, spans = self._spans(score[a:b], letters[a:b])
                own = score[a:b][inside].sum(0)
                margin_ = float(own[k] - np.delete(own, k).max()) if n_langs > 1 else FAR
                out[i] = (self.langs[k], share * (1.0 - float(np.exp(-max(0.0, min(FAR, margin_))))), share, self._fit(own[k], letters[a:b][inside].sum(), k), spans)
        return out

    def _one_language(self, score: np.ndarray, first: np.ndarray, has: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Texts whose best path never leaves their overall language. A path with m switches has
        at most m stretches outside it; if no stretch of any one language gains the penalty,
        all of them together gain less than the m penalties."""
        sizes = np.diff(first)[has]
        over = score - score[np.arange(len(score)), np.repeat(best, sizes)][:, None]
        run = np.cumsum(over, axis=0)
        starts = first[has]
        run -= np.repeat(run[starts] - over[starts], sizes, axis=0)  # sums within each text
        ahead = np.vstack((np.zeros(run.shape[1]), run[:-1]))
        ahead[starts] = 0
        drop = 2 * (np.abs(run).max() + 1) * np.repeat(np.arange(len(has)), sizes)[:, None]  # so that a running minimum starts anew
        low = np.minimum.accumulate(ahead - drop, axis=0) + drop
        return (np.maximum.reduceat(run - low, starts, axis=0).max(1)) < self.penalty

    def _fit(self, total: float, n: float, k: int) -> float:
        return float((total / n - self.mean[k]) / self.spread[k] * n / (n + 200))

    def _spans(self, score: np.ndarray, letters: np.ndarray) -> tuple[int, float, np.ndarray, list[tuple[str, int, int]]]:
        """The leading language, its share of the letters, its words, and all spans."""
        pen, k = self.penalty, score.shape[1]
        value, back = score[0].tolist(), []
        for row in score[1:].tolist():
            top = max(value)
            arg, floor = value.index(top), top - pen
            back.append((arg, [v >= floor for v in value]))
            value = [(v if v >= floor else floor) + e for v, e in zip(value, row)]
        at = value.index(max(value))
        path = [at]
        for arg, stay in reversed(back):
            at = at if stay[at] else arg
            path.append(at)
        path = np.array(path[::-1])
        share = np.bincount(path, weights=letters, minlength=k)
        edges = np.flatnonzero(np.diff(path)) + 1
        begin, end = np.append(0, edges), np.append(edges, len(path))
        best = int(share.argmax())
        return best, float(share[best] / share.sum()), path == best, [(self.langs[path[a]], int(a), int(b - a)) for a, b in zip(begin, end)]


def train(labelled: DataFrame, max_docs: int = 2000, max_langs: int = 256, seed: int = 5) -> Model:
    """labelled: text and lang. Counts come from about max_docs rows of each language, chosen by a
    hash of the text; only the rows of langs and their numbers are seen elsewhere."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = rows.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS + N_SCRIPTS), np.int64))
    share = spark.createDataFrame([(r.lang, min(1.0, max_docs / r["count"])) for r in sizes], "lang string, share double")
    unit = F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 11) * F.lit(2.0**-53)
    sample = rows.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("lang", "text")  # one row for each language
    got = sample.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = got.toArrow()
    counts = np.zeros((len(langs), BUCKETS + N_SCRIPTS), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    if len(lang):
        counts[lang, table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, counts)


def identify(text: Column, model: Model, spark) -> Column:
    """RESULT of each text."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages, of which there are at most max_langs

    @F.arrow_udf(RESULT)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.to_pylist()
            out = [("und", 0.0, 0.0, 0.0, [])] * len(texts)
            for which, run in _chunks(texts, 1 << 21):
                for i, x in zip(which, shared.value.label(run)):
                    out[i] = x
            n = np.cumsum([0, *(len(x[4]) for x in out)])
            spans = [s for x in out for s in x[4]]
            each = pa.StructArray.from_arrays([pa.array([s[0] for s in spans], pa.string()), pa.array([s[1] for s in spans], pa.int32()), pa.array([s[2] for s in spans], pa.int32())], ["lang", "first_word", "n_words"])
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), *(pa.array([x[i] for x in out], pa.float64()) for i in (1, 2, 3)), pa.ListArray.from_arrays(pa.array(n, pa.int32()), each)],
                ["lang_pred", "score", "share", "fit", "spans"],
            )

    return udf(text.cast("string"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, share, fit, spans; learned from the documents that aren't held out."""
    model = model or train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return docs.select("doc_id", held_out().alias("held_out"), identify(F.col("text"), model, docs.sparkSession).alias("r")).select("doc_id", "held_out", "r.*")


def keep_identified(docs: DataFrame, min_share: float = 0.2, min_fit: float = -1.5, model: Model | None = None) -> DataFrame:
    """docs without those whose language is und, whose leading language holds less than min_share of the letters, or
    whose fit is less than min_fit: letters in no learned language's order."""
    model = model or train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    (name,) = unused(docs, "__r")
    r = docs.withColumn(name, identify(F.col("text"), model, docs.sparkSession))
    x = F.col(name)
    return r.where((x["lang_pred"] != "und") & (x["share"] >= min_share) & (x["fit"] >= min_fit)).select(*docs.columns)
