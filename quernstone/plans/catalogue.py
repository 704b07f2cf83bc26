"""Registry of the domain's queries: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from quernstone.plans import audits, differences, failures, governing, releases, runs, trajectories

MODULES = (differences, trajectories, governing, runs, releases, audits, failures)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items()}
