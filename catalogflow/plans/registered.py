"""All registered checks: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
matching DuckDB ``ORACLE[name]`` SQL (absent for rows-only checks)."""

from __future__ import annotations

import importlib

_MODULES = [
    "checks_enrich",
    "checks_merge",
    "checks_html",
    "checks_ledger",
    "checks_misc",
    "checks_events",
    "checks_generation",
    "checks_io",
]


def _collect():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"{__package__}.{m}")
        dup = set(queries) & set(mod.QUERIES)
        if dup:
            raise RuntimeError(f"duplicate check names: {dup}")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


QUERIES, ORACLE = _collect()
