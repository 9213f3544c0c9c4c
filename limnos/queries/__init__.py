"""Driver queries: every operator family applied to the driver's tables, with the equivalent SQL."""

from __future__ import annotations

from limnos.queries import addressed, documents, entities, evidence, forms, landing, measures, planning, streams

MODULES = (measures, entities, documents, planning, forms, landing, addressed, evidence, streams)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
