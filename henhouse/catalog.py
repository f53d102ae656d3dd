"""Registry of the engine's queries: one Spark callable and, where SQL can state it,
an independent DuckDB formulation used as the correctness oracle.

Anchors (FIXTURES.md): ``AS_OF`` for collections, sales and expenses and
``BIRD_AS_OF`` for bird events; both leave rows after the anchor, which exercises
the missing upper bound of the trailing windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from henhouse.sources.adapter import VIEWS
from henhouse.sources.tables import Tables

AS_OF = "2001-07-15"
BIRD_AS_OF = "2024-01-25"

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def with_views(views: tuple[str, ...] | list[str], *extra: str) -> str:
    """WITH prelude for DuckDB: the adapter views the query reads plus extra CTEs."""
    wanted: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in wanted:
            for dep in VIEWS[name][1]:
                need(dep)
            wanted.append(name)

    for v in views:
        need(v)
    parts = [f"{n} AS ({VIEWS[n][0].format(**{d: d for d in VIEWS[n][1]})})" for n in wanted]
    parts.extend(extra)
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            from henhouse.session import ship_package

            ship_package(spark)
            return _fn(Tables.from_testdata(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def _load() -> None:
    # Importing the modules registers their queries.
    from henhouse import queries_catalog  # noqa: F401
