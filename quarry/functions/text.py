"""Text functions as column expressions: tokens, folding, clean-up, truncation, hashes."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"
#: Latin letters with marks and what they fold to (fixed values, position by position).
MARKED = "àáâãäåāçćčďèéêëēěìíîïīñńňòóôõöōřśšťùúûüūůýÿźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaacccdeeeeeeiiiiinnnoooooorsstuuuuuuyyzzzAAAAAACEEEEIIIINOOOOOUUUUY"


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only, as SQLite's LIKE compares."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def accent_fold(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def tokens(c: Column, fold_accents: bool = False) -> Column:
    """Lower-case tokens in order; null and empty texts have none."""
    c = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_extract_all(accent_fold(c) if fold_accents else c, F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Whitespace-separated lower-case words, as set similarity uses them."""
    return F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


#: HTML entities that are decoded (fixed values); others become a space.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™")]
TAG, ENTITY = "<[^>]*>", "&[a-zA-Z0-9#]+;"


def strip_html(c: Column) -> Column:
    """Tags and unknown entities become spaces; known entities are decoded, once."""
    c = F.regexp_replace(c, TAG, " ")
    known = "|".join(e for e, _ in ENTITIES)
    c = F.regexp_replace(c, f"(?!{known}){ENTITY}", " ")
    for name, value in ENTITIES[1:]:
        c = F.replace(c, F.lit(name), F.lit(value))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))  # last, so that what it makes is not decoded again


def html_removed(c: Column) -> Column:
    """How many tags and entities strip_html takes out."""
    return F.regexp_count(c, F.lit(TAG)) + F.regexp_count(F.regexp_replace(c, TAG, " "), F.lit(ENTITY))


#: Markdown constructs in the order they are taken out (fixed values): pattern and what stays.
MARKDOWN = [
    (r"(?m)^#{1,6}\s+", " "), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"_([^_]+)_", "$1"),
    (r"~~([^~]+)~~", "$1"), (r"`([^`]+)`", "$1"), (r"```[\s\S]*?```", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"(?m)^[\s]*[-*+]\s+", ""), (r"(?m)^[\s]*\d+\.\s+", ""), (r"(?m)^>\s*", ""), (r"(?m)^[-*_]{3,}$", ""), (r"\|.*\|", ""),
]


def strip_markdown(c: Column) -> Column:
    for pattern, stays in MARKDOWN:
        c = F.regexp_replace(c, pattern, stays)
    return c


def markdown_removed(c: Column) -> Column:
    """Matches of every construct in the original text."""
    total = F.lit(0)
    for pattern, _ in MARKDOWN:
        total = total + F.regexp_count(c, F.lit(pattern))
    return total


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_\sЀ-ӿ.,!?;:'\"()\-]", " ")


def quick_clean(c: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(F.regexp_replace(c, TAG, " "), ENTITY, " "))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def truncate(c: Column, max_chars: int | None = None, max_tokens: int | None = None, strategy: str = "tail", whole_words: bool = True, indicator: str = "") -> Column:
    """At most max_chars (and 4 * max_tokens) characters: a prefix ("head" and "tail" alike) or two halves
    ("middle"), cut back to the last space if that is beyond 80 %, with an optional indicator."""
    if strategy not in ("head", "tail", "middle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    most = min(x for x in (max_chars, 4 * max_tokens if max_tokens is not None else None, 2**31 - 1) if x is not None)
    goal = most - len(indicator)
    if goal <= 0:
        return F.when(F.length(c) <= most, c).otherwise(F.lit(indicator))
    half = goal // 2
    cut = F.concat(F.substring(c, 1, half), F.right(c, F.lit(half))) if strategy == "middle" else F.substring(c, 1, goal)
    if whole_words:
        last = F.length(cut) - F.instr(F.reverse(cut), " ")  # place of the last space, from 0
        cut = F.when((F.instr(cut, " ") > 0) & (last > goal * 0.8), F.substring(cut, F.lit(1), last)).otherwise(cut)
    if indicator and strategy == "middle":
        mid = F.floor(F.length(cut) / 2).cast("int")
        cut = F.concat(F.substring(cut, F.lit(1), mid), F.lit(indicator), F.substring(cut, mid + 1, F.length(cut)))
    elif indicator:
        cut = F.concat(cut, F.lit(indicator))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def needs_preprocessing(c: Column, html: bool = True, markdown: bool = True, whitespace: bool = True, lower: bool = False, special: bool = False, max_length: int | None = 8192) -> Column:
    """Would process() change the text?"""
    out = F.lit(False)
    if html:
        out = out | c.rlike(TAG) | c.rlike(ENTITY)
    if markdown:
        for pattern, _ in MARKDOWN:
            out = out | c.rlike(pattern)
    if whitespace:
        out = out | (normalize_whitespace(c) != c)
    if lower:
        out = out | (F.lower(c) != c)
    if special:
        out = out | (remove_special(c) != c)
    return out | (F.length(c) > max_length) if max_length else out


def process(c: Column, html: bool = True, markdown: bool = True, whitespace: bool = True, lower: bool = False, special: bool = False,
            max_length: int | None = 8192, custom: Callable[[Column], Column] | None = None) -> Column:
    """The whole preparation of a text: struct<text, original_length, processed_length, estimated_tokens,
    was_truncated, operations, error>. Texts of 0 or over 1 000 000 characters have an error and no text."""
    steps: list[tuple[bool, str, Callable[[Column], Column]]] = [
        (html, "strip_html", strip_html), (markdown, "strip_markdown", strip_markdown), (lower, "lower_case", F.lower),
        (special, "remove_special", remove_special), (custom is not None, "custom", custom or (lambda x: x)), (whitespace, "normalize_whitespace", normalize_whitespace),
    ]
    x, done = c, []
    for wanted, name, f in steps:
        if wanted:
            x, done = f(x), [*done, name]
    cut = truncate(x, max_length) if max_length else x
    truncated = F.length(x) > max_length if max_length else F.lit(False)
    error = F.when(c.isNull() | (F.length(c) == 0), "text is empty").when(F.length(c) > 1_000_000, "text is too long")
    ok = error.isNull()
    operations = F.array(*[F.lit(d) for d in done]) if done else F.expr("cast(array() as array<string>)")
    operations = F.when(truncated, F.array_append(operations, F.lit("truncate"))).otherwise(operations)
    return F.struct(
        F.when(ok, cut).alias("text"), F.length(c).alias("original_length"), F.when(ok, F.length(cut)).alias("processed_length"),
        F.when(ok, estimate_tokens(cut)).alias("estimated_tokens"), (ok & truncated).alias("was_truncated"), operations.alias("operations"), error.alias("error"),
    )


def mask_pii(c: Column) -> Column:
    """Mail addresses, 16-digit card numbers and social security numbers give way to marks."""
    c = F.regexp_replace(c, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]")
    c = F.regexp_replace(c, r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CARD]")
    return F.regexp_replace(c, r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]")


def device_type(agent: Column) -> Column:
    a = F.lower(agent)
    return F.when(a.rlike("tablet|ipad"), "tablet").when(a.rlike("mobile|android|iphone"), "mobile").otherwise("desktop")


def java_hash(c: Column) -> Column:
    """The 31-multiplier 32-bit hash of a string's UTF-16 units, as a signed int in a long column."""
    units = F.split(F.hex(F.encode(c, "UTF-16BE")), "(?<=\\G.{4})")
    number = lambda u: F.conv(u, 16, 10).cast("long")
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    folded = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: F.when(u == "", h).otherwise(wrap(h * 31 + number(u))))
    return F.when(F.length(c) == 0, F.lit(0).cast("long")).otherwise(folded)


def djb_hash(c: Column) -> Column:
    """Bernstein's hash (5381, times 33) of a string's UTF-16 units in lower-case hex, as scripts compute it: only the
    shift wraps to 32 bits, the sum doesn't."""
    units = F.split(F.hex(F.encode(c, "UTF-16BE")), "(?<=\\G.{4})")
    number = lambda u: F.conv(u, 16, 10).cast("long")
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    step = lambda h, u: F.when(u == "", h).otherwise(wrap(wrap(h) * 32) + h + number(u))
    return F.lower(F.hex(F.abs(F.aggregate(units, F.lit(5381).cast("long"), step))))


def zero_blob(n: Column) -> Column:
    """n zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), n))


def random_blob(n: Column, seed: Column) -> Column:
    """n bytes that follow from seed."""
    more = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), lambda i: F.sha2(F.concat(seed.cast("string"), F.lit(":"), i.cast("string")), 256))
    return F.when(n > 0, F.substring(F.unhex(F.array_join(more, "")), F.lit(1), n)).otherwise(F.lit(b""))


def safe_json(c: Column, schema: str, default: Column | None = None) -> Column:
    """c parsed, or default where it can't be."""
    parsed = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return parsed if default is None else F.coalesce(parsed, default)


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def hash_query(c: Column) -> Column:
    """Short name of a query, whatever its case and outer spaces."""
    return base36(F.abs(java_hash(F.lower(F.trim(c)))))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON with sorted names: a stable content key."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def format_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.format_string(f"%.2f {unit}", n / 1024**i))
    return out.otherwise(F.format_string("%.2f TB", n / 1024**4))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).when(ms < 3_600_000, F.format_string("%.1fm", ms / 60_000.0)).otherwise(F.format_string("%.1fh", ms / 3_600_000.0))


def drop_personal(context: Column) -> Column:
    """A map without its personal entries."""
    return F.map_filter(context, lambda k, _: ~k.isin("userId", "email", "personalData"))


def escape_like(s: str) -> str:
    """s as a literal inside LIKE ... ESCAPE '\\'."""
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
