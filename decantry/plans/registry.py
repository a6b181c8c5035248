"""Named queries over the driver tables: a Spark plan plus (where SQL can say it) a DuckDB twin.

A query module registers ``(spark, sf_dir) -> DataFrame`` callables with ``@query``;
``oracle`` is the DuckDB text (already wrapped with the view CTEs) or None for
operators that only get a rows check (path-dependent folds, streaming).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from decantry.plans.sql_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    survey_id: str
    fn: QueryFn
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, survey_id: str, oracle: str | None = None, extra_views: dict[str, str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        sql = with_views(oracle, extra_views) if oracle is not None else None
        REGISTRY[name] = Query(name, survey_id, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules fills REGISTRY.
    from decantry.plans import (q_catalog, q_orders, q_lifecycle, q_rewards,  # noqa: F401
                                q_codes, q_customers, q_stats, q_store, q_outputs)
    return REGISTRY
