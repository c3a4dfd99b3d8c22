"""Structured filters, aggregations, facets and pages over documents or hits."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_of(name: str, columns: list[str]) -> Column:
    """A column, or a path into the metadata JSON ("metadata.a.b" or the name of no column)."""
    if name in columns:
        return F.col(name)
    path = name.removeprefix("metadata.")
    return F.get_json_object("metadata", f"$.{path}")


#: Functions that a script may call.
SCRIPT_FUNCTIONS = frozenset("abs ceil ceiling floor round sqrt pow power mod least greatest length lower upper trim ltrim rtrim substring substr instr contains startswith endswith concat coalesce nullif if ifnull isnull isnotnull size array_contains year month day to_date date_diff get_json_object".split())
_WORDS = frozenset("and or not in is null like rlike between case when then else end true false cast as string int bigint double date timestamp escape distinct from".split())
_SCRIPT = re.compile(r"\s+|'(?:[^'\\]|\\.|'')*'|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|:[A-Za-z_]\w*|`[^`]+`|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|<=>|<=|>=|<>|!=|==|\|\||[-+*/%(),<>=!]")


def script(source: str, params: dict[str, Any]) -> str:
    """A SQL condition over columns with its :params as literals. Only SCRIPT_FUNCTIONS may be called, and there are no
    subqueries, comments or other statements."""
    out, at = [], 0
    while at < len(source):
        m = _SCRIPT.match(source, at)
        if not m:
            raise ValueError(f"a script can't have {source[at : at + 10]!r}")
        t, at = m[0], m.end()
        if t.startswith(":"):
            if t[1:] not in params:
                raise ValueError(f"parameter {t} is missing")
            t = _literal(params[t[1:]])
        elif t[0].isalpha() or t[0] == "_":
            called = re.match(r"\s*\(", source[at:])
            if called and t.lower() not in SCRIPT_FUNCTIONS and t.lower() not in _WORDS or t.lower() in ("select", "with"):
                raise ValueError(f"a script can't call {t}")
        elif out and out[-1] + t in ("--", "/*"):
            raise ValueError("a script can't have comments")
        out.append(t)
    return "".join(out)


def _literal(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"({v!r})"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise ValueError("script parameters are numbers, booleans or strings")


def condition(spec: dict[str, Any], columns: list[str]) -> Column:
    """A filter tree as a column: collections, metadata {k: v}, date_range / numeric_range [{field, ...}],
    text [{field, op, value}], exists / missing [field], must / should / must_not with
    minimum_should_match, and script (a SQL expression with :params)."""
    parts: list[Column] = []
    get = lambda n: field_of(n, columns)
    if spec.get("collections"):
        parts.append(F.col("collection").isin(list(spec["collections"])))
    for k, v in (spec.get("metadata") or {}).items():
        parts.append(get(k).cast("string") == F.lit(str(v).lower() if isinstance(v, bool) else str(v)))
    for r in spec.get("date_range", []):
        c = F.expr(f"try_cast(`{r['field']}` as timestamp)") if r["field"] in columns else get(r["field"]).try_cast("timestamp")
        if r.get("start") is not None:
            parts.append(c >= F.lit(r["start"]).cast("timestamp"))
        if r.get("end") is not None:
            parts.append(c <= F.lit(r["end"]).cast("timestamp"))
    for r in spec.get("numeric_range", []):
        c = get(r["field"]).try_cast("double")
        if r.get("min") is not None:
            parts.append(c >= F.lit(float(r["min"])))
        if r.get("max") is not None:
            parts.append(c <= F.lit(float(r["max"])))
    for r in spec.get("text", []):
        c, v = get(r["field"]).cast("string"), r["value"]
        ops = {"equals": lambda: c == v, "contains": lambda: c.contains(v), "starts_with": lambda: c.startswith(v), "ends_with": lambda: c.endswith(v), "regex": lambda: c.rlike(v)}
        if r["op"] not in ops:
            raise ValueError(f"unknown text filter {r['op']!r}")
        parts.append(ops[r["op"]]())
    parts += [get(n).isNotNull() for n in spec.get("exists", [])]
    parts += [get(n).isNull() for n in spec.get("missing", [])]
    parts += [condition(x, columns) for x in spec.get("must", [])]
    parts += [~F.coalesce(condition(x, columns), F.lit(False)) for x in spec.get("must_not", [])]
    if spec.get("should"):
        n = sum((F.coalesce(condition(x, columns), F.lit(False)).cast("int") for x in spec["should"]), F.lit(0))
        need = spec.get("minimum_should_match", 0 if spec.get("must") else 1)
        parts.append(n >= need)
    if spec.get("script"):
        parts.append(F.expr(script(spec["script"]["source"], spec["script"].get("params", {}))))
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def apply(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    return df.where(condition(spec, df.columns))


def aggregate(df: DataFrame, name: str, kind: str, field: str, size: int | None = None, interval: float | str | None = None, ranges: list[dict] | None = None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """terms, histogram, date_histogram, range or stats of a field; keep adds grouping columns (facets by query)."""
    c = field_of(field, df.columns)
    out = None
    if kind == "terms":
        out = df.groupBy(*keep, c.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("doc_count"))
        if size is not None:
            from pyspark.sql import Window

            w = Window.partitionBy(*keep).orderBy(F.desc("doc_count"), "key") if keep else None
            out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= size).drop("__n") if w is not None else out.orderBy(F.desc("doc_count"), "key").limit(size)
    elif kind == "histogram":
        step = float(interval)
        out = df.where(c.isNotNull()).groupBy(*keep, (F.floor(c.try_cast("double") / step) * step).alias("key")).agg(F.count(F.lit(1)).alias("doc_count"))
    elif kind == "date_histogram":
        out = df.groupBy(*keep, F.date_trunc(str(interval), c.cast("timestamp")).alias("key")).agg(F.count(F.lit(1)).alias("doc_count"))
    elif kind in ("range", "date_range"):
        x = c.try_cast("double") if kind == "range" else c.cast("timestamp")
        typed = (lambda v: F.lit(float(v))) if kind == "range" else (lambda v: F.lit(v).cast("timestamp"))
        # a value may fall into several ranges
        names = []
        for r in ranges or []:
            ok = F.lit(True)
            if r.get("from") is not None:
                ok = ok & (x >= typed(r["from"]))
            if r.get("to") is not None:
                ok = ok & (x < typed(r["to"]))
            names.append(F.when(ok, F.lit(r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}")))
        out = df.select(*keep, F.explode(F.filter(F.array(*names), lambda k: k.isNotNull())).alias("key")).groupBy(*keep, "key").agg(F.count(F.lit(1)).alias("doc_count"))
    elif kind == "stats":
        x = c.try_cast("double")
        return df.groupBy(*keep).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.sum(x).alias("sum")).withColumn("name", F.lit(name))
    else:
        raise ValueError(f"unknown aggregation {kind!r}")
    return out.withColumn("name", F.lit(name))


def page(hits: DataFrame, limit: int = 20, offset: int = 0, cursor: tuple[float, int] | None = None) -> DataFrame:
    """A page of hits (score, rowid), best first: by offset, or after a cursor (score, rowid of the last row seen)."""
    if cursor is not None:
        score, rowid = cursor
        hits = hits.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("rowid") > rowid)))
    out = hits.orderBy(F.desc("score"), "rowid")
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


def advanced(docs: DataFrame, hits: DataFrame, filters: dict | None = None, aggregations: dict[str, dict] | None = None, facets: dict[str, dict] | None = None, limit: int = 20, offset: int = 0) -> dict[str, DataFrame]:
    """The parts of an advanced search: hits (a page), and each aggregation and facet over all filtered hits."""
    rows = docs.join(hits, "rowid")
    if filters:
        rows = apply(rows, filters)
    out = {"hits": page(rows, limit, offset)}
    for name, a in {**(aggregations or {}), **(facets or {})}.items():
        out[name] = aggregate(rows, name, **a)
    return out
