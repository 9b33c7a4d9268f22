"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from .plans import explore, more, network, scalars, tiling

MODULES = (explore, tiling, network, scalars, more)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}
