"""Registry: query key → (Spark callable, DuckDB oracle SQL or None).

The Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names equal the oracle's. A ``None`` oracle means the operator is not
expressible in SQL (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starlayer.plans.context import Ctx, finish

QueryFn = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(key: str, sql: str | None = None):
    """Decorator for ``fn(ctx) -> DataFrame``; wraps it as ``(spark, sf_dir)``."""

    def deco(fn: Callable[[Ctx], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Ctx(spark, sf_dir)))

        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        if key in _REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        _REGISTRY[key] = (run, sql)
        return fn

    return deco


def _load() -> None:
    # Import for side effects: each module registers its queries.
    from starlayer.plans import (  # noqa: F401
        layer_plans,
        quality_plans,
        fact_plans,
        dim_plans,
        metric_plans,
        advise_plans,
        sink_plans,
        stream_plans,
    )


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1] is not None}
