"""Query analysis and planning: columns of a queries DataFrame (query_id, query)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let

# Word lists (fixed values).
QUESTION = "что как где когда почему кто какой which what how where when why who".split()
BOOLEAN = "and or not".split()
STOP_PLAN = "the a an and or but in on at to for of with by в на с по для и или но что как где когда".split()
STOP_ANALYZER = STOP_PLAN + "this that it is was are were be been have has had do does did".split()
POSITIVE = "good great excellent amazing wonderful perfect best love like".split()
NEGATIVE = "bad terrible awful horrible worst hate problem issue error wrong".split()
FORMAL = "please kindly would could may might should".split()
INFORMAL = "hey hi yo gonna wanna gotta yeah yep nope".split()
DOMAINS = {
    "tech": "software hardware programming code api database",
    "business": "sales marketing revenue profit customer client",
    "science": "research study analysis experiment theory",
    "personal": "my me personal private own",
}
TIMES = {
    "past": ["was", "were", "did", "had", "yesterday", "ago", "last", "past", "previous"],
    "future": ["will", "shall", "going to", "tomorrow", "next", "future", "plan", "predict"],
    "present": ["is", "are", "now", "currently", "today", "present"],
}
FIND, VERIFY, COMPARE, URGENT = "find show list display", "check verify confirm validate", "compare vs difference", "urgent quickly asap immediately now"
SYNONYMS = {
    "find": ["search", "locate", "discover"], "good": ["excellent", "great", "wonderful"],
    "bad": ["poor", "terrible", "awful"], "показать": ["отобразить", "вывести", "представить"],
}
SEED_IDF = {"the": 0.1, "and": 0.2, "database": 2.5, "search": 3.0, "algorithm": 4.0}
#: Codes of what could improve a query.
SUGGESTIONS = {"vague": "be_more_specific", "short": "add_keywords", "unknown": "quote_the_phrase", "special": "drop_special_characters"}
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@dataclass
class Context:
    has_embeddings: bool = False
    documents: int = 0
    mean_length: float = 0.0
    default_mode: str = "auto"
    fallback: str = "keyword"
    historical_accuracy: float = 0.0


def any_word(c: Column, words: list[str] | str, found: Column | None = None) -> Column:
    """Does the text have one of the words (or phrases), as whole ASCII words, in any case? found: the text's
    ascii_words, among these at least; then the text is read for phrases only whose words are all there."""
    words = words.split() if isinstance(words, str) else words
    if found is None:
        return c.rlike(f"(?i){LEFT}(?:{'|'.join(words)}){RIGHT}")
    out = F.arrays_overlap(found, F.array(*[F.lit(w) for w in words if w in _parts([w])]))
    for phrase in (w for w in words if w not in _parts([w])):
        there = F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in _parts([phrase])]))) == len(_parts([phrase]))
        out = out | (there & any_word(c, [phrase]))
    return out


def _parts(words: list[str]) -> list[str]:
    """The distinct ASCII words in words and phrases."""
    return list(dict.fromkeys(x for w in words for x in re.findall("[a-z0-9_]+", w)))


def ascii_words(c: Column, among: list[str]) -> Column:
    """The distinct ASCII words of a text, in lower case, that the words and phrases are made of: one pass over the
    text serves any number of any_word."""
    own = F.transform(F.array_distinct(F.split(c, "[^A-Za-z0-9_]+")), F.lower)
    return F.array_intersect(own, F.array(*[F.lit(w) for w in _parts(among)]))


def normalize_plan(q: Column, unicode: bool = False) -> Column:
    """Lower case, single spaces, special characters out. The literal form keeps ASCII words only."""
    keep = r"[^\p{L}\p{N}_\s\"'\-]" if unicode else r"[^A-Za-z0-9_\s\"'\-]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(q)), r"\s+", " "), keep, " "))


def normalize_analyzer(q: Column, unicode: bool = False) -> Column:
    keep = r"[^\p{L}\p{N}_\s\-\"'.,!?()]" if unicode else r"[^A-Za-z0-9_\s\-\"'.,!?()]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(q, F.lit(""))), r"\s+", " "), keep, " "))


def query_features(q: Column, analyzer: bool = False) -> Column:
    """struct of ten features of a normalised query."""
    return let(F.split(q, r"\s+"), lambda ws: _features(q, ws, analyzer))


def _features(q: Column, ws: Column, analyzer: bool) -> Column:
    n = F.size(ws)
    question = q.rlike(f"(?i)^(?:{'|'.join(QUESTION)}){RIGHT}")
    boolean = any_word(q, BOOLEAN)
    intent = F.when(question, "search").when(boolean, "filter").when(n == 1, "navigate").when(q.contains("vs") | q.contains("против") | q.contains("compare"), "compare").otherwise("search")
    stop = F.array(*[F.lit(w) for w in (STOP_ANALYZER if analyzer else STOP_PLAN)])
    return F.struct(
        n.alias("word_count"), question.alias("has_question_words"), boolean.alias("has_boolean_operators"), q.rlike("[*?]").alias("has_wildcards"), q.rlike('"[^"]*"').alias("has_quotes"),
        q.rlike("[0-9]").alias("has_numbers"), q.rlike(r"[!@#$%^&*()_+=\[\]{}|\\:\";'<>?,./]").alias("has_special_characters"),
        (F.length(F.array_join(ws, "")) / n).alias("average_word_length"),
        F.arrays_overlap(F.split(F.lower(q), r"\s+"), stop).alias("contains_stop_words"), intent.alias("estimated_intent"),
    )


def query_type(q: Column, f: Column, analyzer: bool = False) -> Column:
    question = f["has_question_words"] | q.endswith("?") if analyzer else f["has_question_words"]
    return (
        F.when(f["has_quotes"], "exact_phrase").when(f["has_boolean_operators"], "boolean_query").when(f["has_wildcards"], "wildcard").when(question, "question")
        .when(f["has_numbers"] & (f["word_count"] <= 3), "numeric").when(f["word_count"] <= 3, "short_keyword").otherwise("long_phrase")
    )


def _bonus(c: Column, x: float) -> Column:
    return F.when(c, F.lit(x)).otherwise(F.lit(0.0))


def confidence(kind: Column, f: Column, analyzer: bool = False, ctx: Context | None = None) -> Column:
    ctx = ctx or Context()
    n = f["word_count"]
    if not analyzer:
        s = F.lit(0.5) + _bonus(f["has_quotes"], 0.3) + _bonus(f["has_boolean_operators"], 0.25) + _bonus(f["has_wildcards"], 0.2) + _bonus(f["has_question_words"], 0.2)
        return F.least(F.lit(1.0), s + F.when(n == 1, 0.1).when(n >= 4, 0.15).otherwise(0.0))
    s = F.lit(0.5) + _bonus(f["has_quotes"], 0.4) + _bonus(f["has_boolean_operators"], 0.35) + _bonus(f["has_wildcards"], 0.3) + _bonus(f["has_question_words"], 0.25)
    s = s + F.when(n == 1, 0.15).when((n >= 4) & (n <= 8), 0.1).when(n > 15, -0.1).otherwise(0.0) + F.lit(0.1 * ctx.historical_accuracy)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), s + (_bonus(kind == "question", 0.1) if ctx.has_embeddings else F.lit(0.0))))


def primary_strategy(kind: Column, f: Column, ctx: Context) -> Column:
    smart = ctx.has_embeddings
    return (
        F.when(kind == "exact_phrase", "exact_match").when(kind == "boolean_query", "boolean").when(kind == "wildcard", "fuzzy").when(kind == "question", "semantic" if smart else "keyword")
        .when(kind == "short_keyword", F.when(f["word_count"] == 1, "exact_match").otherwise("keyword")).when(kind == "long_phrase", "semantic" if smart else "phrase")
        .when(kind.isin("numeric", "entity"), "exact_match").otherwise(ctx.fallback)
    )


def _present(*options: tuple[Column, str], most: int) -> Column:
    return F.slice(F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in options]), lambda x: x.isNotNull()), 1, most)


def alternatives(strategy: Column, kind: Column, ctx: Context, most: int = 3) -> Column:
    return _present((strategy != "keyword", "keyword"), (F.lit(ctx.has_embeddings) & (strategy != "semantic"), "semantic"), (strategy != "fuzzy", "fuzzy"), ((kind == "long_phrase") & (strategy != "phrase"), "phrase"), most=most)


def fallbacks(strategy: Column) -> Column:
    two = lambda a, b: F.array(F.lit(a), F.lit(b))
    return F.when(strategy.isin("semantic", "exact_match"), two("keyword", "fuzzy")).when(strategy == "phrase", two("keyword", "proximity")).otherwise(F.array(F.lit("keyword")))


def mode(strategy: Column, ctx: Context, asked: str | None = None) -> Column:
    if asked and asked != "auto":
        return F.lit(asked)
    return F.when(strategy == "semantic", "vector_only").when(strategy.isin("exact_match", "keyword", "boolean"), "fts_only").when(strategy.isin("phrase", "fuzzy"), "hybrid").otherwise(ctx.default_mode)


def weights(strategy: Column, kind: Column, override: dict[str, float] | None = None) -> Column:
    """struct of seven fusion weights."""
    on = lambda c, v, other: F.when(c, F.lit(v)).otherwise(other)
    s, w = strategy, {}
    w["fts"] = on(s == "semantic", 0.2, on(s.isin("exact_match", "keyword"), 0.8, F.lit(0.7)))
    w["vector"] = on(s == "semantic", 0.8, on(s == "keyword", 0.2, F.lit(0.3))) + _bonus(kind == "question", 0.1)
    w["exact_match"] = on(s == "exact_match", 1.5, F.lit(1.2)) + _bonus(kind == "short_keyword", 0.2)
    w["phrase_match"] = on(s == "phrase", 1.3, F.lit(1.1)) + _bonus(kind == "long_phrase", 0.1)
    w["proximity"] = on(s == "phrase", 1.2, F.lit(1.0)) + _bonus(kind == "long_phrase", 0.1)
    w["freshness"], w["popularity"] = F.lit(0.1), F.lit(0.1)
    w.update({k: F.lit(float(v)) for k, v in (override or {}).items()})
    return F.struct(*[c.alias(k) for k, c in w.items()])


def complexity(f: Column, ctx: Context, analyzer: bool = False, intent: Column | None = None, specificity: Column | None = None) -> Column:
    pt = lambda c, x: F.when(c, x).otherwise(0)
    corpus = F.lit((2 if ctx.documents > 100_000 else 0) + (1 if ctx.mean_length > 5000 else 0))
    if not analyzer:
        s = pt(f["word_count"] > 5, 2) + pt(f["has_boolean_operators"], 2) + pt(f["has_wildcards"], 1) + pt(f["has_quotes"], 1) + corpus
        return F.when(s <= 2, "low").when(s <= 5, "medium").otherwise("high")
    n = f["word_count"]
    s = F.when(n > 8, 3).when(n > 5, 2).when(n <= 2, 1).otherwise(0) + pt(f["has_boolean_operators"], 3) + pt(f["has_wildcards"], 2) + pt(f["has_quotes"], 1) + pt(f["has_special_characters"], 1) + corpus
    s = s + (pt(intent == "compare", 2) if intent is not None else F.lit(0)) + (pt(specificity == "broad", 1) if specificity is not None else F.lit(0))
    return F.when(s <= 3, "low").when(s <= 7, "medium").otherwise("high")


def intent(q: Column, f: Column) -> Column:
    """struct<primary, confidence, secondary, urgency, specificity, domain, temporality>."""
    known = [*" ".join((FIND, VERIFY, COMPARE, URGENT, *DOMAINS.values())).split(), *(w for ws in TIMES.values() for w in ws)]
    return let(ascii_words(q, known), lambda found: _intent(q, f, found))


def _intent(q: Column, f: Column, words: Column) -> Column:
    compare = f["estimated_intent"] == "compare"
    find, verify = any_word(q, FIND, words), any_word(q, VERIFY, words)
    question, filt = f["has_question_words"], f["has_boolean_operators"] | f["has_numbers"]
    nav = (f["word_count"] == 1) & ~f["has_special_characters"]
    primary = F.when(question, "search").when(filt, "filter").when(nav, "navigate").when(compare, "compare").when(find, "discover").when(verify, "verify").otherwise("search")
    sure = F.when(question, 0.8).when(filt | nav | find | verify, 0.7).otherwise(0.5)
    secondary = _present((question & any_word(q, COMPARE, words), "compare"), (find & (primary != "discover"), "discover"), (verify & (primary != "verify"), "verify"), most=3)
    urgency = F.when(any_word(q, URGENT, words), "high").when(q.rlike("(?i)when possible|eventually|sometime"), "low").otherwise("medium")
    specificity = F.when((f["word_count"] <= 2) & ~f["has_quotes"], "broad").when(f["has_quotes"] | f["has_numbers"], "precise").otherwise("specific")

    def first(table: dict[str, str | list[str]], default: str) -> Column:
        out = F.lit(default)
        for name, ws in reversed(table.items()):
            out = F.when(any_word(q, ws.split() if isinstance(ws, str) else ws, words), name).otherwise(out)
        return out

    return F.struct(primary.alias("primary"), F.least(F.lit(1.0), F.greatest(F.lit(0.1), sure)).alias("confidence"), secondary.alias("secondary"), urgency.alias("urgency"), specificity.alias("specificity"), first(DOMAINS, "general").alias("domain"), first(TIMES, "timeless").alias("temporality"))


def expansion(q: Column, concepts: Column | None = None) -> Column:
    """struct<original_terms, added, synonyms, concepts, expanded, confidence>: each word that has synonyms adds its
    best one (0.1 each), and new words of over three letters of related queries (concepts, an array<string>, such as
    related_queries gives) are concepts (0.05 each, at most 3). The expanded query gets two of the first and one of
    the second."""
    syn = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    heads = F.array(*[F.lit(k) for k in SYNONYMS])
    known = lambda ws: F.when(~F.arrays_overlap(ws, heads), F.expr("cast(array() as array<string>)")).otherwise(F.filter(ws, lambda w: F.array_contains(heads, w)))
    return let(F.split(F.lower(q), r"\s+"), lambda ws: let(known(ws), lambda k: _expansion(ws, k, syn, concepts)))


def _expansion(ws: Column, known: Column, syn: Column, concepts: Column | None) -> Column:
    none = F.expr("cast(array() as array<string>)")
    added = F.transform(known, lambda w: F.element_at(F.try_element_at(syn, w), 1))
    past = none if concepts is None else F.flatten(F.transform(F.coalesce(concepts, F.array()), lambda c: F.split(F.lower(c), r"\s+")))
    new = F.slice(F.filter(past, lambda w: ~F.array_contains(ws, w) & ~F.array_contains(added, w) & (F.length(w) > 3)), 1, 3)
    sure = F.least(F.lit(1.0), F.round(0.5 + 0.1 * F.size(added) + 0.05 * F.size(new), 10))
    all_syn = F.flatten(F.transform(F.array_distinct(known), lambda w: F.try_element_at(syn, w)))
    expanded = F.concat(ws, F.slice(added, 1, 2), F.slice(new, 1, 1))
    return F.struct(ws.alias("original_terms"), added.alias("added"), all_syn.alias("synonyms"), new.alias("concepts"), expanded.alias("expanded"), sure.alias("confidence"))


ENTITIES = {"DATE": r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", "NUMBER": r"\b\d+(?:\.\d+)?\b", "PERSON": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "ORGANIZATION": r"\b[A-Z]{2,}\b"}


#: Numbers that are summed as one where sums of all before a place are asked for.
BLOCK = 128


def entities(q: Column) -> Column:
    """array<struct<text, type, start, end>>; starts come from what precedes each match."""
    placed = lambda kind, p: let(F.regexp_extract_all(q, F.lit(p), F.lit(0)), lambda found: _placed(q, kind, p, found))
    return F.concat(*[placed(kind, p) for kind, p in ENTITIES.items()])


def count_entities(q: Column) -> Column:
    """The size of entities, without the places."""
    return sum((F.size(F.regexp_extract_all(q, F.lit(p), F.lit(0))) for p in ENTITIES.values()), F.lit(0))


def _placed(q: Column, kind: str, p: str, found: Column) -> Column:
    """The matches of a kind with their places. A text without any is not split."""
    none = F.expr("cast(array() as array<struct<text: string, type: string, start: int, end: int>>)")
    gaps = F.transform(F.split(q, p, -1), lambda s: F.length(s))
    steps = lambda g: F.transform(found, lambda m, i: F.get(g, i) + F.length(m))
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), (F.size(xs) / BLOCK).cast("int")), lambda b: _total(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))

    def one(g: Column, xs: Column, sums: Column):
        def at(m: Column, i: Column) -> Column:
            b = (i / BLOCK).cast("int")
            start = _total(F.slice(sums, F.lit(1), b)) + _total(F.slice(xs, b * BLOCK + 1, i - b * BLOCK)) + F.get(g, i)
            return let(start, lambda s: F.struct(m.alias("text"), F.lit(kind).alias("type"), s.alias("start"), (s + F.length(m)).alias("end")))

        return at

    placed = let(gaps, lambda g: let(steps(g), lambda xs: let(blocks(xs), lambda sums: F.transform(found, one(g, xs, sums)))))
    return F.when(F.size(found) == 0, none).otherwise(placed)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def keywords(q: Column, idf: dict[str, float] | None = None, most: int = 10) -> Column:
    """array<struct<weight, word, pos>>: tf * idf, a fifth more for a word that starts the query; words of over two
    letters, heaviest first. Words are counted as runs of the sorted words."""
    table = {**SEED_IDF, **(idf or {})}
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    pos = lambda w: F.when(w.endswith("ing"), "VBG").when(w.endswith("ed"), "VBD").when(w.endswith("s"), "NNS").when(w.endswith("ly"), "RB").otherwise("NN")
    longer = lambda ws: F.sort_array(F.filter(ws, lambda w: F.length(w) > 2))
    starts = lambda ws: F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (w != F.get(ws, i - 1)), i)), lambda i: i.isNotNull())

    def weighed(low: Column, n: Column, ws: Column, at: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            w, tf = F.get(ws, i), (F.coalesce(F.get(at, j + 1), F.size(ws)) - i) / n
            return F.struct((-tf * F.coalesce(F.try_element_at(m, w), F.lit(1.0)) * F.when(low.startswith(w), 1.2).otherwise(1.0)).alias("w"), w.alias("word"))

        return F.slice(F.sort_array(F.transform(at, one)), 1, most)

    best = let(F.lower(q), lambda low: let(F.split(low, r"\s+"), lambda all_: let(longer(all_), lambda ws: let(starts(ws), lambda at: weighed(low, F.size(all_), ws, at)))))
    return F.transform(best, lambda x: F.struct((-x["w"]).alias("weight"), x["word"].alias("word"), pos(x["word"]).alias("pos")))


def linguistics(q: Column) -> Column:
    """struct<language, language_confidence, sentiment, formality, complexity>: Russian if any letter is Cyrillic,
    English if the whole text is of Latin letters, digits, white space and . , ! ?."""
    ws = F.split(q, r"\s+")
    n, mean = F.size(ws), F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w)) / F.size(ws)
    ru, en = q.rlike("[\u0400-\u04ff]"), q.rlike(r"^[a-zA-Z\s\d.,!?]+\z")
    return F.struct(
        F.when(ru, "ru").when(en, "en").otherwise("unknown").alias("language"), F.when(ru | en, 0.8).otherwise(0.5).alias("language_confidence"),
        F.when(any_word(q, POSITIVE), "positive").when(any_word(q, NEGATIVE), "negative").otherwise("neutral").alias("sentiment"),
        F.when(any_word(q, FORMAL), "formal").when(any_word(q, INFORMAL), "informal").otherwise("mixed").alias("formality"),
        F.when((n <= 3) & (mean <= 5), "simple").when((n > 8) | (mean > 8), "complex").otherwise("moderate").alias("complexity"),
    )


def vector_20(f: Column, sure: Column) -> Column:
    """The features as 20 numbers."""
    flag = lambda n: f[n].cast("double")
    made = [f["word_count"] / 10.0, flag("has_question_words"), flag("has_boolean_operators"), flag("has_wildcards"), flag("has_quotes"), flag("has_numbers"), flag("has_special_characters"), f["average_word_length"] / 10.0, flag("contains_stop_words"), sure]
    return F.concat(F.array(*[c.cast("double") for c in made]), F.array_repeat(F.lit(0.0), 10))


def vector_100(q: Column, idf: dict[str, float] | None = None) -> Column:
    """tf * idf of the query's words, hashed into 100 places."""
    ws = F.split(F.lower(q), r"\s+")
    table = {**SEED_IDF, **(idf or {})}
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    pairs = F.transform(ws, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(100)).cast("int").alias("i"), (F.coalesce(F.try_element_at(m, w), F.lit(1.0)) / F.size(ws)).alias("x")))
    return F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(p["i"] == i, p["x"]).otherwise(F.lit(0.0))))


def suggestions(sure: Column, f: Column, kind: Column, threshold: float = 0.7) -> Column:
    return _present((sure < threshold, SUGGESTIONS["vague"]), (f["word_count"] == 1, SUGGESTIONS["short"]), (kind == "unknown", SUGGESTIONS["unknown"]), (f["has_special_characters"], SUGGESTIONS["special"]), most=4)


def analyze(queries: DataFrame, ctx: Context | None = None, analyzer: bool = False, unicode: bool = False) -> DataFrame:
    """queries with the columns of a basic analysis."""
    ctx = ctx or Context()
    q = normalize_analyzer(F.col("query"), unicode) if analyzer else normalize_plan(F.col("query"), unicode)
    df = queries.withColumn("normalized", q)
    q = F.col("normalized")
    df = df.withColumn("features", query_features(q, analyzer))
    f = F.col("features")
    df = df.withColumn("query_type", query_type(q, f, analyzer))
    k = F.col("query_type")
    return df.withColumn("confidence", confidence(k, f, analyzer, ctx)).withColumn("strategy", primary_strategy(k, f, ctx)).withColumn("complexity", complexity(f, ctx, analyzer))


def combine(df: DataFrame, favourites: DataFrame | None = None, ctx: Context | None = None) -> DataFrame:
    """Base and advanced analyses together: confidence 0.4 / 0.6 and an arbitrated strategy. favourites
    (user_id, strategy, clicks) is heeded from three clicks on; df then needs user_id."""
    ctx = ctx or Context()
    basic = analyze(df, ctx).select("*").withColumnsRenamed({"query_type": "base_type", "confidence": "base_confidence", "strategy": "base_strategy", "complexity": "base_complexity", "features": "base_features", "normalized": "base_normalized"})
    both = analyze(basic, ctx, analyzer=True).withColumn("intent", intent(F.col("normalized"), F.col("features")))
    if favourites is not None:
        best = favourites.where("clicks >= 3").groupBy("user_id").agg(F.max_by("strategy", "clicks").alias("favourite"))
        both = both.join(best, "user_id", "left")
    else:
        both = both.withColumn("favourite", F.lit(None).cast("string"))
    i, adv, base = F.col("intent"), F.col("strategy"), F.col("base_strategy")
    chosen = F.when(F.lit(ctx.has_embeddings) & i["primary"].isin("compare", "discover"), "semantic").when(i["specificity"] == "precise", "exact_match").when((i["urgency"] == "high") & (adv == "semantic"), "keyword")
    chosen = chosen.when(F.col("favourite").isNotNull(), F.col("favourite")).when(F.col("confidence") > 0.8, adv).when((adv == "semantic") | (base == "semantic"), "semantic").when((adv == "exact_match") | (base == "exact_match"), "exact_match").otherwise(base)
    return both.withColumn("final_strategy", chosen).withColumn("final_confidence", 0.4 * F.col("base_confidence") + 0.6 * F.col("confidence"))


def plan(df: DataFrame, ctx: Context | None = None, strategy: str = "strategy", asked_mode: str | None = None, override: dict[str, float] | None = None) -> DataFrame:
    """The execution plan of each analysed query: struct<strategy, mode, weights, fallbacks, alternatives, limit, offset>."""
    ctx = ctx or Context()
    s, k = F.col(strategy), F.col("query_type")
    return df.withColumn("plan", F.struct(s.alias("strategy"), mode(s, ctx, asked_mode).alias("mode"), weights(s, k, override).alias("weights"), fallbacks(s).alias("fallbacks"), alternatives(s, k, ctx).alias("alternatives"), F.lit(20).alias("limit"), F.lit(0).alias("offset")))


def related_queries(queries: DataFrame, history: DataFrame, most: int = 5) -> DataFrame:
    """query_id, related, overlap: past queries (query) that share over 30 % of the query's words."""
    asked = queries.select("query_id", F.array_distinct(F.split(F.lower("query"), r"\s+")).alias("w"))
    past = history.select(F.col("query").alias("related")).distinct().select("related", F.explode(F.array_distinct(F.split(F.lower("related"), r"\s+"))).alias("word"))
    hits = asked.select("query_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(past, "word")
    got = hits.groupBy("query_id", "n", "related").agg(F.count(F.lit(1)).alias("c")).select("query_id", "related", (F.col("c") / F.col("n")).alias("overlap")).where("overlap > 0.3")
    from .search import top

    return top(got, most, F.desc("overlap"), F.col("related"))
