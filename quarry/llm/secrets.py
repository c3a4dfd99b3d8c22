"""Secret scans: candidates by pattern, then a random forest that removes false positives.

Candidates and their neighbouring text come from one pattern inside the row. The forest is
trained by Spark ML on labelled findings (a bounded table of reviewed findings; by default
``labelled_findings``, drawn from the shapes that reviewers confirm or dismiss) and compiled to a
column expression, so scanning, scoring and redaction are a single projection over the
documents: no text is shuffled, and a document with many candidates or a hot source costs only
its own rows. The dictionary is that of the corpus: the ``DICTIONARY`` words that most documents
hold, counted over all of them, without labels.

Candidates: private-key blocks up to their END line (or as far as their lines go), what follows
a key word and = or :, what follows a key word and is long, and long runs of token characters
that have a digit or mixed case inside.

Features: length, digit/upper/lower shares, character-class transitions, distinct
characters, dictionary coverage, path shape, known formats, key words and hash words near
the candidate, and whether the neighbours (candidates included) look like candidates.

Defined cases: null and empty texts have no findings and come back unchanged; equal
candidates in a text are findings of their own, numbered by position; repeated rows each
give theirs; candidates of any length are read whole; an empty table gives an empty result;
other columns are untouched, whatever their names.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

KEYS = "pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credentials?"
HASHES = "commit|sha-?1|sha-?256|md5|hash|checksum|digest|revision|etag|uuid|guid|build|version|file|page|isbn"
FAKES = "example|placeholder|changeme|dummy|sample|redacted|xxxx|your[_-]|1234567890|abcdef0123"
FORMATS = "^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk-[A-Za-z0-9_-]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+$|PRIVATE KEY"
_BODY = r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\\[rn]|\s)*+[A-Za-z0-9+/=]{40,}+)*+)"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----" + _BODY +
    r"|(?<![A-Za-z0-9])(?i:" + KEYS + r""")["']?\s?[=:]\s?["']?[^\s"'<>,;]{6,}+"""
    r"|(?<![A-Za-z0-9])(?i:" + KEYS + r")\s(?:(?i:is|was)\s)?[A-Za-z0-9+/_.=-]{20,}+"
    r"|(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9]|[A-Z+/_.=-]*+[a-z+/_.=-]++[A-Z])[A-Za-z0-9+/_.=-]{16,}+"
)
VALUE = r"^(?i:" + KEYS + r""")(?:["']?\s?[=:]\s?["']?|\s(?:(?i:is|was)\s)?)(.*)$"""
#: Words of the dictionary, and letters that they have at least.
DICTIONARY, SHORTEST = 2000, 4
FEATURES = ["f_len", "f_digit", "f_upper", "f_lower", "f_trans", "f_distinct", "f_dict", "f_path", "f_format", "f_key", "f_hash", "f_fake", "f_hex", "f_near", "f_assign"]
NEAR = 48


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The words (of SHORTEST letters or more, in lower case) that most of all documents hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{SHORTEST},}}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(most).collect()]


def _features(v: Column, own: Column, before: Column, after: Column, known: list[str]) -> list[Column]:
    """v: the value; own: the key before it in the match, if any; known: the dictionary."""
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda p: F.regexp_count(v, F.lit(p)) / size
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    # words are runs of letters, also those that capitals divide
    runs = F.regexp_extract_all(v, F.lit(rf"\p{{Lu}}?\p{{Ll}}{{{SHORTEST - 1},}}|\p{{Lu}}{{{SHORTEST},}}"), F.lit(0))
    words = F.filter(F.transform(runs, F.lower), lambda w: w.isin(known)) if known else F.array(F.lit(""))
    near = r"(?:^|\s)[A-Za-z0-9+/_=-]{24,}(?:\s|$)"
    out = [
        size, share("[0-9]"), share("[A-Z]"), share("[a-z]"),
        F.regexp_count(v, F.lit("[a-z](?=[0-9A-Z])|[0-9](?=[A-Za-z])|[A-Z](?=[0-9a-z])")) / size,
        F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(64.0)),
        F.length(F.array_join(words, "")) / size,
        flag(v.rlike(r"/[A-Za-z0-9._-]+/|^\.{0,2}/|\.(?:com|org|net|html?|png|jpg|js|css|md|py|txt)\b|^www\.|^https?:")),
        flag(v.rlike(FORMATS)),
        flag(own.rlike(r"\S") | F.lower(before).rlike(f"(?:{KEYS})[^A-Za-z0-9]*(?:is|was)?\\W*$")),
        flag(F.lower(before).rlike(f"(?:{HASHES})\\W*$") | F.lower(own).rlike(HASHES)),
        flag(F.lower(v).rlike(FAKES) | v.rlike(r"^(.)\1{5}")),
        flag(v.rlike("^[0-9a-f]+$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        flag(before.rlike(near) | after.rlike(near)),
        flag(own.rlike(r"\S")),
    ]
    return [c.cast("double").alias(n) for c, n in zip(out, FEATURES)]


def _finding(match: Column, before: Column, after: Column, known: list[str]) -> tuple[Column, Column]:
    own = F.when(match.rlike(VALUE), F.regexp_extract(match, f"^(?i:{KEYS})", 0)).otherwise(F.lit(""))
    v = F.when(match.rlike(VALUE), F.regexp_extract(match, VALUE, 1)).otherwise(match)
    return v, F.struct(*_features(v, own, before, after, known))


def labelled_findings(n: int = 2400, seed: int = 7) -> list[tuple[str, str, str, float]]:
    """(before, match, after, label): findings drawn from the shapes that reviewers confirm or dismiss."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    vowel = lambda k: "".join(r.choice(["the", "an", "er", "tion", "on", "in", "re", "st", "le", "que", "en", "ung", "ent"]) for _ in range(k))
    prose = lambda k: " ".join(vowel(r.randint(1, 3)) for _ in range(k))
    key = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth"])
    true = [
        lambda: ("", f"{key()}{r.choice('=:')}{pick(r.choice([hexa, alnum, alnum + '!@#$%']), r.randint(8, 40))}"),
        lambda: (r.choice(["", f"{key()} is "]), r.choice(["AKIA", "ASIA"]) + pick(upper, 16)),
        lambda: ("", r.choice(["ghp_", "gho_"]) + pick(alnum, 36)),
        lambda: ("", "sk-" + pick(alnum, r.randint(24, 48))),
        lambda: ("", "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24)),
        lambda: ("", "AIza" + pick(alnum, 35)),
        lambda: ("", f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum, 43)}"),
        lambda: (f"{key()} ", pick(alnum, r.randint(20, 44))),
        lambda: (f"{key()}: ", pick(hexa, r.choice([32, 40]))),
        lambda: ("", "-----BEGIN RSA PRIVATE KEY-----" + "".join("\n" + pick(alnum + "+/", 64) for _ in range(r.randint(0, 12))) + r.choice(["\n-----END RSA PRIVATE KEY-----", ""])),
        lambda: ("", f"{r.choice(['api key', 'access key', 'token', 'secret is'])} {pick(string.ascii_letters, r.randint(24, 44))}"),
        lambda: (r.choice(["", f"{key()} "]), pick(string.ascii_letters, r.randint(28, 44))),
    ]
    false = [
        lambda: (r.choice(["commit ", "sha1 ", "md5: ", "checksum ", "revision ", "", ""]), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (r.choice(["uuid ", "id ", ""]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", "/".join(["", vowel(2), vowel(3), f"{vowel(1)}{r.randint(1, 999)}.{r.choice(['html', 'png', 'js'])}"])),
        lambda: ("", f"www.{vowel(2)}{r.randint(1, 99)}.com/{vowel(2)}/{r.randint(1, 9999)}"),
        lambda: ("", pick("0123456789", r.randint(16, 24))),
        lambda: ("", f"{key()}={r.choice(['changeme', 'your_password_here', 'xxxxxxxxxxxx', 'example1234', 'placeholder', 'dummy_value'])}"),
        lambda: ("", f"{vowel(3)}_{vowel(3)}_{r.randint(1, 99)}"),
        lambda: ("", f"{vowel(3)}-{vowel(4)}-{r.randint(1990, 2030)}"),
        lambda: ("", "=" * r.randint(8, 20) + str(r.randint(0, 9)) + "=" * 10),
        lambda: (pick(hexa, 40) + "\n", pick(hexa, 40)),
        lambda: ("", f"token: {vowel(r.randint(3, 5))}"),
        lambda: ("", f"secret: {vowel(r.randint(3, 5))}"),
        lambda: ("", "".join(vowel(r.randint(1, 2)).capitalize() for _ in range(r.randint(4, 6)))),
        lambda: ("", vowel(2) + "".join(vowel(r.randint(1, 2)).capitalize() for _ in range(r.randint(4, 6)))),
        lambda: ("", f"token {vowel(r.randint(8, 12))}"),
    ]
    out = []
    for i in range(n):
        kinds, label = (true, 1.0) if i % 2 else (false, 0.0)
        lead, match = kinds[(i // 2) % len(kinds)]()
        out.append((f"{prose(r.randint(0, 3))} {lead}"[-NEAR:], match, f" {prose(r.randint(0, 3))}"[:NEAR], label))
    return out


class Forest:
    """A random forest as text of a SQL expression over a struct x of FEATURES, and the dictionary it knows."""

    def __init__(self, sql: str, known: list[str]):
        self.sql, self.known = sql, known

    @staticmethod
    def rows(findings: DataFrame, known: list[str]) -> DataFrame:
        """findings with a vector of their features."""
        from pyspark.ml.feature import VectorAssembler

        _, f = _finding(F.col("match"), F.col("before"), F.col("after"), known)
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings.coalesce(1).select(f.alias("x"), "label").select("x.*", "label"))

    @classmethod
    def fit(cls, rows: DataFrame, n_trees: int = 24, depth: int = 7, seed: int = 11):
        """Spark ML's model."""
        from pyspark.ml.classification import RandomForestClassifier

        return RandomForestClassifier(numTrees=n_trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)

    @classmethod
    def compiled(cls, model, known: list[str]) -> Forest:
        trees = [cls._node(t._call_java("rootNode")) for t in model.trees]
        return cls("((" + " + ".join(trees) + f") / {len(trees)}D)", known)

    @classmethod
    def train(cls, findings: DataFrame, known: list[str], **options) -> Forest:
        """findings: before, match, after, label (1 secret, 0 not), a bounded table of reviewed findings."""
        return cls.compiled(cls.fit(cls.rows(findings, known), **options), known)

    @staticmethod
    def _node(node) -> str:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / max(sum(stats), 1e-9)!r}D"
        split = node.split()
        return f"CASE WHEN x.features.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {Forest._node(node.leftChild())} ELSE {Forest._node(node.rightChild())} END"


FINDINGS = "before string, match string, after string, label double"


def default_forest(docs: DataFrame, findings: DataFrame | None = None) -> Forest:
    """Trained on findings (or labelled_findings()) with the dictionary of docs."""
    if findings is None:
        findings = docs.sparkSession.createDataFrame(labelled_findings(), FINDINGS)
    return Forest.train(findings, dictionary(docs))


KIND_SQL = """CASE WHEN x.value rlike '^(AKIA|ASIA)[0-9A-Z]{16}$' THEN 'access_key_id' WHEN x.value rlike '^gh[pousr]_' THEN 'forge_token'
 WHEN x.value rlike '^eyJ' THEN 'web_token' WHEN x.value rlike 'PRIVATE KEY' THEN 'private_key' WHEN x.features.f_assign = 1 THEN 'assignment' ELSE 'opaque' END"""


def with_findings(docs: DataFrame, forest: Forest, threshold: float = 0.5, into: str = "findings") -> DataFrame:
    """docs and two more columns: ``into``, array<struct<k, kind, value, score, is_secret, match>> by position, and the
    text between the matches (null without any)."""
    text, cand = F.col("text").cast("string"), F.lit(CANDIDATE)
    matches, between, x, y = unused(docs, "__matches", "__between", "__x", "__y")
    pieces, all_ = F.col(between), F.col(matches)

    def one(m: Column, i: Column) -> Column:
        back = F.when(i > 0, F.get(all_, i - 1)).otherwise(F.lit(""))
        before = F.right(F.concat(F.right(back, F.lit(NEAR)), F.get(pieces, i)), F.lit(NEAR))
        after = F.left(F.concat(F.get(pieces, i + 1), F.left(F.coalesce(F.get(all_, i + 1), F.lit("")), F.lit(NEAR))), F.lit(NEAR))
        v, f = _finding(m, before, after, forest.known)
        return F.struct(i.alias("k"), m.alias("match"), v.alias("value"), f.alias("features"))

    out = docs.withColumn(matches, F.regexp_extract_all(text, cand, F.lit(0))).withColumn(between, F.when(F.size(matches) > 0, F.split(text, CANDIDATE, -1)))
    out = out.withColumn(x, F.transform(matches, one))
    scored = F.expr(f"transform(`{x}`, x -> named_struct('k', x.k, 'match', x.match, 'value', x.value, 'kind', {KIND_SQL}, 'score', {forest.sql}))")
    out = out.withColumn(y, scored)
    final = F.transform(y, lambda y: F.struct(y["k"].alias("k"), y["kind"].alias("kind"), y["value"].alias("value"), y["score"].alias("score"), (y["score"] >= threshold).alias("is_secret"), y["match"].alias("match")))
    return out.select(*docs.columns, final.alias(into), pieces)


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate of every text: doc_id, k, kind, value, score, is_secret."""
    forest = forest or default_forest(docs)
    found = with_findings(docs.select("doc_id", "text"), forest, threshold)
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.k", "f.kind", "f.value", "f.score", "f.is_secret")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of a text replaced by mark; other text stays byte for byte."""
    forest = forest or default_forest(docs)
    (into,) = unused(docs, "__findings")
    found = with_findings(docs, forest, threshold, into)
    pieces = F.col(found.columns[-1])
    swap = F.transform(into, lambda f: F.when(f["is_secret"], F.lit(mark)).otherwise(f["match"]))
    parts = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(swap, i), F.lit(""))))
    text = F.when(F.exists(into, lambda f: f["is_secret"]), F.array_join(parts, "")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
