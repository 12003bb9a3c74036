"""Every registered query and its SQL statement."""

from __future__ import annotations

from sparkshelf.plans import checks, extras, labels, logs, retrieval, text

MODULES = (text, retrieval, labels, logs, extras, checks)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
