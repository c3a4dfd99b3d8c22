"""Query rewriting and summaries by an injected language-model provider."""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

MAX_PROMPT = 4000
RESULT_CHARS = 200


class ProviderError(Exception):
    """retryable: a new attempt may succeed (rate limits, server errors)."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


class TextProvider(ABC):
    @abstractmethod
    def complete(self, prompt: str, **options) -> str: ...


class CallableProvider(TextProvider):
    def __init__(self, f: Callable[..., str]):
        self.f = f

    def complete(self, prompt: str, **options) -> str:
        return self.f(prompt, **options)


def delay(attempt: int, base: float = 1.0, jitter: float = 0.0, most: float = 30.0) -> float:
    """Seconds before attempt + 1 (attempts count from 1)."""
    return min(2 ** (attempt - 1) * base + jitter, most)


def call(provider: TextProvider, prompt: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep, **options) -> str:
    if not prompt.strip():
        raise ValueError("a prompt is a non-empty string")
    if len(prompt) > MAX_PROMPT:
        raise ValueError(f"a prompt has at most {MAX_PROMPT} characters")
    for attempt in range(1, retries + 2):
        try:
            return provider.complete(prompt, **options)
        except ProviderError as e:
            if not e.retryable or attempt > retries:
                raise
            sleep(delay(attempt))
    raise AssertionError


def enhance_prompt(query: str, max_suggestions: int = 5) -> str:
    return f'Improve this search query. Answer with JSON: {{"enhanced": "...", "suggestions": [up to {max_suggestions}], "intent": "..."}}.\nQuery: {query}'


def summary_prompt(query: str, rows: list[dict], max_length: int = 300) -> str:
    lines = [f"{i}. {(r.get('title') or '')}: {(r.get('content') or '')[:RESULT_CHARS]}" for i, r in enumerate(rows, 1)]
    return (f'Summarise these search results for "{query}" in at most {max_length} characters. Answer with JSON: {{"summary": "...", "key_points": [], "themes": []}}.\n' + "\n".join(lines))[:MAX_PROMPT]


def _json(text: str, default: dict) -> dict:
    a, z = text.find("{"), text.rfind("}")
    try:
        return {**default, **json.loads(text[a : z + 1])} if a >= 0 else default
    except ValueError:
        return default


@dataclass
class Assisted:
    hits: object
    enhanced: dict = field(default_factory=dict)
    summary: dict = field(default_factory=dict)


def enhance_query(provider: TextProvider, query: str, **options) -> dict:
    """enhanced, suggestions, intent; the query itself if the answer can't be read."""
    return {"original": query, **_json(call(provider, enhance_prompt(query), **options), {"enhanced": query, "suggestions": [], "intent": "search"})}


def summarize_results(provider: TextProvider, query: str, rows: list[dict], **options) -> dict:
    if not rows:
        return {"summary": "", "key_points": [], "themes": []}
    return _json(call(provider, summary_prompt(query, rows), **options), {"summary": "", "key_points": [], "themes": []})


def search_with_text_model(provider: TextProvider, query: str, run: Callable[[str], object], fetch: Callable[[object], list[dict]], enhance: bool = True, summarize: bool = True, **options) -> Assisted:
    """Rewrite the query, search with run, and summarise what fetch takes of its hits (a page, not the result)."""
    better = enhance_query(provider, query, **options) if enhance else {"enhanced": query}
    hits = run(better["enhanced"])
    return Assisted(hits, better, summarize_results(provider, query, fetch(hits), **options) if summarize else {})
