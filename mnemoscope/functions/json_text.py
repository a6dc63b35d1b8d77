"""Text and bounded copies of nested JSON, whose depth no built-in expression can follow; Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Limits of search texts and of payloads. Fixed values.
FRAGMENTS, FRAGMENT_CHARS, SEARCH_CHARS = 48, 400, 2400
DEPTH, ITEMS, STRING_CHARS, PAYLOAD_BYTES, PREVIEW_CHARS = 5, 48, 4096, 4096, 256
#: Fields of a payload that are left out. Fixed values.
OUTPUT_FIELDS = ("stdout", "stderr", "raw_stdout", "raw_stderr", "command_output", "tool_output")

_EMAIL, _PHONE = re.compile(text.EMAIL), re.compile(text.PHONE)
#: What a match of each pattern of SECRET_LIKE holds, one of them at least; in small letters only where no other letter folds to them.
_MARKS = (("-----",), (":", "="), ("sk-",), ("sk-proj-",), ("AKIA",), ("_",), ("github_pat_",), ("xox",), (":", "="), (":",), ("bearer",))
_SECRETS = [(marks, re.compile(text.any_of((pattern,)))) for marks, pattern in zip(_MARKS, text.SECRET_LIKE, strict=True)]


def _parsed(raw: str | None) -> tuple[bool, Any]:
    """Whether ``raw`` is JSON, and its value; JSON nested beyond what the parser takes counts as none."""
    try:
        return True, json.loads(raw or "")
    except (ValueError, RecursionError):
        return False, None


def _squeezed(value: str) -> str:
    return " ".join(value.split())


def _leaves(value: Any) -> Iterator[str]:
    """Strings and numbers below ``value``, depth first, the keys of an object in order."""
    waiting = [value]
    while waiting:
        at = waiting.pop()
        if isinstance(at, dict):
            waiting += [at[key] for key in sorted(at, reverse=True)]
        elif isinstance(at, list):
            waiting += reversed(at)
        elif isinstance(at, str) and at.strip():
            yield _squeezed(at)
        elif isinstance(at, (int, float)) and not isinstance(at, bool):
            yield str(at)


def _fragments(raw: str | None) -> list[str]:
    is_json, value = _parsed(raw)
    found = _leaves(value) if is_json else iter([_squeezed(raw or "")])
    return [x[:FRAGMENT_CHARS] for x in islice(found, FRAGMENTS)]


def _searchable(summary: str | None, *raws: str | None) -> str:
    parts = dict.fromkeys([_squeezed(summary or ""), *(_squeezed(x) for raw in raws for x in _fragments(raw))])
    return "\n".join(x for x in parts if x)[:SEARCH_CHARS].rstrip()


def _spoken(value: Any) -> str:
    """Keys and values of JSON as one text, without the fields whose name ends in _id."""
    if isinstance(value, dict):
        said = ((key, _spoken(x)) for key, x in value.items() if not key.endswith("_id"))
        return " ".join(f"{key} {x}" for key, x in said if x)
    if isinstance(value, list):
        return " ".join(filter(None, map(_spoken, value)))
    return "" if value is None else str(value)


def _said(raw: str | None) -> str:
    value = _parsed(raw)[1]
    try:
        return _spoken(value)
    except RecursionError:
        return " ".join(_leaves(value))


def _safe(value: str) -> str:
    # A payload may be one long word, in which a search for a mark is a hundredth of one for a pattern.
    small = value.lower()
    if any(any(m in value or m in small for m in marks) and pattern.search(value) for marks, pattern in _SECRETS):
        return "[REDACTED_SECRET]"
    clean = _EMAIL.sub("[REDACTED_EMAIL]", value) if "@" in value else value
    clean = _PHONE.sub("[REDACTED_PHONE]", clean) if not clean.isascii() or any(d in clean for d in "0123456789") else clean
    return clean if len(clean) <= STRING_CHARS else clean[:STRING_CHARS] + "…"


def _bounded(value: Any, room: int = DEPTH) -> Any:
    if room < 0:
        return "[TRUNCATED_DEPTH]"
    if isinstance(value, str):
        return _safe(value)
    if isinstance(value, list):
        return [_bounded(x, room - 1) for x in value[:ITEMS]]
    if not isinstance(value, dict):
        return value
    first = list(islice(value.items(), ITEMS))
    kept = {key: _bounded(x, room - 1) for key, x in first if key.strip().lower() not in OUTPUT_FIELDS}
    notes = {"_truncated_items": len(value) > ITEMS, "_redacted_output_fields": len(first) - len(kept)}
    return kept | {key: x for key, x in notes.items() if x}


_dumped = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def _payload(raw: str | None) -> str | None:
    """Canonical JSON of at most PAYLOAD_BYTES, else a note of its size with a preview; null for what isn't JSON."""
    is_json, value = _parsed(raw)
    if not is_json or value is None:
        return None
    body = _dumped(_bounded(value))
    size = len(body.encode())
    if size <= PAYLOAD_BYTES:
        return body
    return _dumped({"_truncated": True, "reason": "payload_cap", "original_bytes": size, "preview": body[:PREVIEW_CHARS]})


def _by_row(f: Callable[..., str | None]) -> Callable[..., Column]:
    """A column function that applies ``f`` to the strings of a row, an Arrow batch at a time; null reaches it as None."""

    def batch(*columns: pd.Series) -> pd.Series:
        rows = zip(*(c.astype(object).where(c.notna(), None) for c in columns), strict=True)
        return pd.Series([f(*row) for row in rows], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return batch(a)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return batch(a, b, c)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else three, "string")(*columns)


def search_text(summary: Column, payload: Column, refs: Column) -> Column:
    """The summary and the strings and numbers of two JSON columns, a line each, each once.

    At most 48 of a column, 400 characters each, 2,400 in all. What isn't JSON counts as
    one string; null and empty give nothing.
    """
    return _by_row(_searchable)(summary, payload, refs)


def spoken(raw: Column) -> Column:
    """JSON as one text of keys and values; empty for null and for what isn't JSON, values alone if nested by the hundred."""
    return _by_row(_said)(raw)


def bounded(raw: Column) -> Column:
    """JSON without fields of tool output, secrets, addresses or numbers of phones; bounded in depth, items and bytes."""
    return _by_row(_payload)(raw)
