"""All queries of the lattice library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its own or the given name. sql follows the fixtures' WITH list; one that starts with WITH or SELECT stands alone."""

    def keep(f: Callable) -> Callable:
        FOUND[name or f.__name__] = f, sql
        return f

    return keep


def _load() -> None:
    from latticeframe.plans import queries_grains, queries_nodes, queries_sources  # noqa: F401  (they register themselves)


def queries() -> dict[str, Callable]:
    _load()
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from latticeframe.plans.fixtures import SQL

    _load()
    whole = lambda s: s if s.lstrip().lower().startswith("with") else f"with {SQL} {s}"
    return {name: whole(sql) for name, (_, sql) in FOUND.items() if sql}
