"""JSON objects as models write them: fenced, preceded by thoughts, or alone in a list."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

_fence = re.compile(r"^```(?:json)?\s*\n(.*?)\n?```$", re.DOTALL | re.IGNORECASE)
_thought = re.compile(r"^<think>.*?</think>\s*", re.DOTALL | re.IGNORECASE)


def object_of(text: str | None) -> dict[str, Any] | None:
    """The one object that a reply consists of; None for prose around it, several objects, or anything else."""
    body = _thought.sub("", (text or "").strip())
    fenced = _fence.match(body)
    body = fenced.group(1).strip() if fenced else body
    try:
        value = json.loads(body)
    except ValueError:
        return None
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    return value if isinstance(value, dict) else None


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys, so that equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any, size: int = 20) -> str:
    """Hex digits of the SHA-256 of the canonical text."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:size]


def flattened(value: dict[str, Any], prefix: str = "") -> dict[str, float]:
    """Numeric leaves under dotted names; flags are 0 and 1, nulls and texts are left out."""
    out: dict[str, float] = {}
    for key, item in value.items():
        name = f"{prefix}{key}"
        if isinstance(item, dict):
            out |= flattened(item, name + ".")
        elif isinstance(item, (bool, int, float)):
            out[name] = float(item)
    return out


def leaf_texts(value: Any) -> list[str]:
    """Keys and leaf values as texts, in order; nulls and blank texts are left out."""
    if isinstance(value, dict):
        return [x for key, item in value.items() for x in [str(key), *leaf_texts(item)]]
    if isinstance(value, list):
        return [x for item in value for x in leaf_texts(item)]
    text = "" if value is None else str(value).strip()
    return [text] if text else []


def bounded(value: Any, items: int = 16, chars: int = 500, depth: int = 3) -> Any:
    """A value with at most ``items`` members of each list and object, texts of at most ``chars``, and what lies deeper than ``depth`` as text."""
    if isinstance(value, (dict, list)) and depth <= 0:
        return canonical(value)[:chars]
    if isinstance(value, dict):
        return {str(k)[:120]: bounded(v, items, chars, depth - 1) for k, v in list(value.items())[:items]}
    if isinstance(value, list):
        return [bounded(v, items, chars, depth - 1) for v in value[:items]]
    return value if value is None or isinstance(value, (bool, int, float)) else str(value)[:chars]
