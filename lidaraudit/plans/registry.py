"""All queries of the library, with their SQL, by module."""

from __future__ import annotations

from lidaraudit.plans import geometry, review, rules, streams, temporal

MODULES = (rules, geometry, review, temporal, streams)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
