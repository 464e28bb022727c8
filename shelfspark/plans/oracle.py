"""Compose oracle SQL: prefix a query body with the fixture views it reads."""

from __future__ import annotations

import re

from .oracle_views import VIEWS

_NAMES = list(VIEWS)


def _refs(sql: str) -> set[str]:
    return {n for n in _NAMES if re.search(rf"\b{n}\b", sql)}


def with_views(body: str) -> str:
    """``WITH <needed views> <body>``; views come in the order of ``VIEWS``."""
    need: set[str] = set()
    todo = _refs(body)
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo |= _refs(VIEWS[n]) - {n}
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _NAMES if n in need)
    body = body.strip()
    if not ctes:
        return body
    m = re.match(r"(?i)with\s+recursive\s", body)
    if m:
        return f"WITH RECURSIVE {ctes},\n{body[m.end():]}"
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
