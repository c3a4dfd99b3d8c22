"""Checks of what callers hand over: requests by declared shapes, values by rules, errors by what helps against them."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from typing import Any

#: Requests: field -> kind; a kind that ends in ? may be absent. "rows" is a list of dicts, "values" a list of SQL values.
SHAPES: dict[str, dict[str, str]] = {
    "open": {"filename": "str", "path": "str?", "pragmas": "dict?"},
    "execute": {"sql": "str", "params": "values?"},
    "select": {"sql": "str", "params": "values?"},
    "bulk_insert": {"table": "str", "rows": "rows"},
    "search": {"query": "str?", "vector": "vector?", "collection": "str?", "limit": "number?", "threshold": "number?", "hybrid": "bool?"},
    "create_collection": {"name": "str", "dimensions": "number?", "config": "dict?"},
    "insert_document": {"collection": "str", "document": "dict", "options": "dict?"},
    "semantic_search": {"collection": "str", "query": "str", "options": "dict?"},
    "export": {"format": "str?"},
    "import": {"data": "any", "format": "str?", "overwrite": "bool?"},
    "embed": {"text": "str", "collection": "str?", "options": "dict?"},
    "embed_batch": {"requests": "rows", "options": "dict?"},
    "enqueue": {"collection": "str", "document_id": "str", "text": "str", "priority": "number?"},
    "process_queue": {"collection": "str?", "batch_size": "number?", "max_retries": "number?"},
    "clear_queue": {"collection": "str?", "status": "str?"},
}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def is_sql_value(x: Any) -> bool:
    return x is None or isinstance(x, (str, int, float, bytes, bytearray)) or is_vector(x)


def is_vector(x: Any) -> bool:
    """A non-empty sequence of finite numbers."""
    return isinstance(x, (list, tuple)) and len(x) > 0 and all(is_number(v) for v in x)


def is_json(x: Any) -> bool:
    try:
        json.dumps(x, allow_nan=False)
    except (TypeError, ValueError):
        return False
    return True


def is_identifier(x: Any) -> bool:
    return isinstance(x, str) and bool(_IDENTIFIER.match(x))


def is_document_id(x: Any) -> bool:
    return isinstance(x, str) and 0 < len(x.strip()) <= 255


_KINDS = {
    "str": lambda x: isinstance(x, str), "number": is_number, "bool": lambda x: isinstance(x, bool), "dict": lambda x: isinstance(x, dict), "any": lambda x: x is not None, "vector": is_vector,
    "rows": lambda x: isinstance(x, list) and all(isinstance(r, dict) for r in x), "values": lambda x: isinstance(x, list) and all(map(is_sql_value, x)),
}


def problems(request: str, params: Any) -> list[str]:
    """What is wrong with a request's parameters; nothing for good ones."""
    shape = SHAPES[request]
    if not isinstance(params, dict):
        return [f"{request} takes named parameters"]
    out = []
    for name, kind in shape.items():
        if params.get(name) is None:
            if not kind.endswith("?"):
                out.append(f"{name} is missing")
        elif not _KINDS[kind.rstrip("?")](params[name]):
            out.append(f"{name} is no {kind.rstrip('?')}")
    if request == "search" and not out and params.get("query") is None and params.get("vector") is None:
        out.append("a search needs a query or a vector")
    return out


def check(request: str, params: Any) -> dict:
    if found := problems(request, params):
        raise ValueError(f"{request}: " + "; ".join(found))
    return params


@dataclass(frozen=True)
class Classified:
    kind: str
    severity: str
    recoverable: bool
    message: str


#: What an error's text tells of it: pattern, kind, severity, whether a new attempt may succeed, what to say.
_RULES = [
    (r"out of memory|heap space|MEMORY_LIMIT", "memory", "critical", False, "There is not enough memory for this request."),
    (r"no space left|quota", "storage", "high", False, "The storage is full."),
    (r"timed? ?out", "timeout", "medium", True, "The request took too long; try again or ask for less."),
    (r"another writer|conflict", "concurrency", "medium", True, "The table was changed meanwhile; try again."),
    (r"rate limit|\b429\b|\b50[0234]\b|connection (?:refused|reset)", "provider", "medium", True, "The service is busy; try again later."),
    (r"TABLE_OR_VIEW_NOT_FOUND|no table|no such table|UNRESOLVED_COLUMN", "schema", "high", False, "The query names a table or column that doesn't exist."),
    (r"PARSE_SYNTAX_ERROR|syntax error", "syntax", "medium", False, "The query can't be read."),
]


def classify(error: BaseException) -> Classified:
    text = f"{type(error).__name__}: {error}"
    if isinstance(error, (TimeoutError, ConnectionError)) or getattr(error, "retryable", False):
        return Classified("provider", "medium", True, "The service is busy; try again later.")
    for pattern, kind, severity, recoverable, message in _RULES:
        if re.search(pattern, text, re.IGNORECASE):
            return Classified(kind, severity, recoverable, message)
    if isinstance(error, (ValueError, TypeError)):
        return Classified("input", "low", False, str(error))
    return Classified("unknown", "medium", False, "The request failed.")
