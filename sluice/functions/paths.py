"""Field paths: dotted, or JSON Pointers if they begin with a slash."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def split(path: str) -> list[str]:
    """Keys of a path; none for the empty path."""
    if not path:
        return []
    if path[0] != "/":
        return path.split(".")
    return [key.replace("~1", "/").replace("~0", "~") for key in path[1:].split("/")]


def lookup(fields: Mapping | None, keys: list[str]) -> tuple[Any, bool]:
    """The value at the keys and whether there is one. Only objects are walked; a null value is there."""
    if not keys:
        return None, False
    at: Any = fields
    for key in keys:
        if not isinstance(at, Mapping) or key not in at:
            return None, False
        at = at[key]
    return at, True


def get(fields: Mapping | None, path: str) -> tuple[Any, bool]:
    return lookup(fields, split(path))


def variant_path(keys: list[str]) -> str | None:
    """The keys as a path for Spark's variant functions; None if a key holds both kinds of quotes, which such a path can't."""
    if any('"' in key and "'" in key for key in keys):
        return None
    return "$" + "".join(f"['{key}']" if '"' in key else f'["{key}"]' for key in keys)
