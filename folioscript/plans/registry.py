"""All registered queries with their SQL twins (``None`` = rows-only)."""

from __future__ import annotations

from folioscript.plans import cast_queries, script_queries, status_queries, stream_queries, text_queries, timeline_queries

MODULES = [text_queries, timeline_queries, cast_queries, status_queries, script_queries, stream_queries]


def all_queries() -> dict:
    out: dict = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = pair
    return out
