"""All queries of the library proper, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import communities, concepts, contexts, edit_join, incremental, java_routes, lint, readers, search_index, terms, tools, typed, vector_index  # noqa: F401  (they register their queries)
from .operators.analytics import EXTRA
from .operators.catalog import CATALOG, Query
from .sources.driver_tables import GraphTables


def key(name: str) -> str:
    return name.replace("-", "_")


def _runner(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.example(GraphTables.of(spark, sf_dir))

    run.__doc__ = query.about
    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["hub-functions-by-caller-breadth"].example(GraphTables.of(spark, sf_dir))


LINT = {"lint_issues": lambda: lint.plan(lint.REGISTERED_DAY), "lint_summary": lambda: lint.summary(lint.REGISTERED_DAY)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {key(n): _runner(q) for n, q in CATALOG.items()}
    found |= {n: (lambda spark, sf_dir, f=f: f(GraphTables.of(spark, sf_dir))) for n, (f, _) in EXTRA.items()}
    found |= {n: (lambda spark, sf_dir, f=f: f().spark(GraphTables.of(spark, sf_dir))) for n, f in LINT.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {key(n): q.sql() for n, q in CATALOG.items()}
    found |= {n: sql for n, (_, sql) in EXTRA.items() if sql}
    found |= {n: lint.sql(f()) for n, f in LINT.items()}
    return found
