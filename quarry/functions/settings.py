"""Configurations: defaults of a collection, recursive merging, names."""

from __future__ import annotations

import copy
from typing import Any

#: Batch sizes, seconds and characters by provider (fixed values; "local" runs beside the engine).
PROVIDERS = {"local": {"batch_size": 32, "timeout": 30.0, "max_length": 8192}, "remote": {"batch_size": 100, "timeout": 10.0, "max_length": 8191}}


def merge_configs(base: dict, *changes: dict) -> dict:
    """A new dict: nested dicts are merged, anything else (lists too) replaced; None leaves what is there."""
    out = copy.deepcopy(base)
    for change in changes:
        for k, v in change.items():
            if v is None:
                continue
            out[k] = merge_configs(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def vector_table_name(collection: str, dimensions: int) -> str:
    return f"vec_{collection}_{dimensions}d"


def collection_config(provider: str = "local", dimensions: int = 384, **changes: Any) -> dict:
    """The default configuration of a collection's embeddings, with changes merged into it."""
    p = PROVIDERS[provider]
    base = {
        "provider": provider, "dimensions": dimensions, "batch_size": p["batch_size"], "timeout": p["timeout"], "cache": True, "auto_generate": False,
        "preprocessing": {"max_length": p["max_length"], "strip_html": True, "strip_markdown": True, "normalize_whitespace": True, "lower_case": False, "remove_special": False},
    }
    return merge_configs(base, changes)
