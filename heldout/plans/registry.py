"""Registry of the queries and of the DuckDB SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}

_SIDE_VIEWS = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def view(name: str, sql: str) -> None:
    """A named SQL view usable by later views and oracle queries."""
    VIEWS[name] = sql.strip()


def _needed(sql: str, seen: set[str]) -> None:
    for word in _SIDE_VIEWS.findall(sql):
        if word in VIEWS and word not in seen:
            seen.add(word)
            _needed(VIEWS[word], seen)


def with_views(body: str) -> str:
    seen: set[str] = set()
    _needed(body, seen)
    if not seen:
        return body
    # a CTE of its own in the body goes after the shared views
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in seen]
    body = body.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", "WITH " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register
