"""The registry of queries and of their oracle SQL."""

from __future__ import annotations

from tessera.plans import backups, curation, evidence, gates, joins, listings, pages, papers, parts, quality, registry, results, scoring, search, serving, sets, streams, texts, trees, validation, windows  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE_SQL)
