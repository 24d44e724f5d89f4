"""Registered queries over the test tables, each next to its check SQL."""

from __future__ import annotations

from tabulon.workload.common import Registry


def registry() -> Registry:
    from tabulon.workload import cleaning, clusters, models, profiles, retrieve, runs, scores, tables, texts

    out = Registry()
    for part in (tables, profiles, cleaning, texts, clusters, models, scores, retrieve, runs):
        for name, fn in part.queries.queries.items():
            out.add(name, part.queries.sql.get(name))(fn)
    return out
