"""JSON without the tolerance of common readers."""

from __future__ import annotations

import json
import math

MAX_DEPTH = 256


def _pairs(items: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(items)
    if len(out) < len(items):
        seen: set[str] = set()
        twice = next(k for k, _ in items if k in seen or seen.add(k))
        raise ValueError(f"duplicate key: {twice}")
    return out


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"number out of range: {text}")
    return value


def _constant(text: str) -> float:
    raise ValueError(f"not a JSON number: {text}")


def depth(text: str) -> int:
    """Deepest nesting of arrays and objects, by brackets outside strings."""
    now = most = 0
    inside = escaped = False
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "[{":
            now += 1
            most = max(most, now)
        elif c in "]}":
            now -= 1
    return most


def load(text: str) -> object:
    """Parse; duplicate keys, NaN, infinities and deep nesting are errors."""
    if depth(text) > MAX_DEPTH:
        raise ValueError(f"nesting deeper than {MAX_DEPTH}")
    try:
        return json.loads(text, object_pairs_hook=_pairs, parse_float=_number, parse_constant=_constant)
    except RecursionError as error:
        raise ValueError("nesting too deep") from error


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
