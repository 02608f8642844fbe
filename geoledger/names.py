"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column has, whatever its case."""
    taken, found, k = {c.lower() for c in columns}, name, 0
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found
