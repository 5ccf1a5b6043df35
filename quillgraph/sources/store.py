"""Writing and versioning the graph, history, and guarded ad-hoc SQL."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Point to a version that is written as a whole."""
    spark.createDataFrame([(version, SCHEMA_VERSION, time.time())], "version string, schema int, at double").coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def write_graph(tables: Mapping[str, DataFrame], root: str) -> str:
    """Write all tables to a new version and point to it last: readers see the former version or the whole new one."""
    spark = next(iter(tables.values())).sparkSession
    version = new_version()
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    publish(spark, root, version)
    return version


def reset_graph(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], keep: list[str] | None = None) -> str:
    """A new version of these tables; ``keep`` names tables of the last version that stay as they are (all others go)."""
    kept = read_graph(spark, root, [n for n in keep or [] if n not in tables])
    return write_graph({**kept, **tables}, root)


def read_graph(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    last = spark.read.parquet(f"{root}/pointer").orderBy(F.desc("at")).first()
    if last.schema != SCHEMA_VERSION:
        raise ValueError(f"the graph has schema {last.schema}; this library reads {SCHEMA_VERSION}")
    return {n: spark.read.parquet(f"{root}/{last.version}/{n}") for n in names}


def valid_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose both ends exist; others are dropped without a word."""
    return edges.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, the new ones for the old."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def trim_history(history: DataFrame, most: int = 1000) -> DataFrame:
    """The newest rows, by at: each partition's newest are compared, not the whole history."""
    return history.orderBy(F.desc("at")).limit(most)


def schema_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, columns, rows) of each table, in one plan."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), F.lit(",".join(df.columns)).alias("columns"), "rows") for n, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("rows"), "name")


#: The parser's nodes that only read.
READING = frozenset(
    "Aggregate Distinct Except Filter GlobalLimit Generate InlineTable Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range "
    "Sample Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith "
    "UnresolvedTableValuedFunction Unpivot Window WithWindowDefinition".split()
)
#: Functions that reach beyond the tables.
BARRED = frozenset(["reflect", "try_reflect", "java_method", "raise_error"])


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _check(plan, allowed: set[str]) -> None:
    """Raise unless all nodes of a parsed plan, with its common tables and subqueries, read only what is allowed."""
    kind = plan.getClass().getSimpleName()
    if kind not in READING:
        raise ValueError(f"only reading statements are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = ".".join(_seq(plan.multipartIdentifier()))
        if name.lower() not in allowed:
            raise ValueError(f"no table {name}")
    if kind == "UnresolvedWith":
        for named in _seq(plan.cteRelations()):
            _check(named._2(), allowed | {named._1().lower()})
            allowed = allowed | {named._1().lower()}
    for child in _seq(plan.children()):
        _check(child, allowed)
    for e in _seq(plan.expressions()):
        _check_expression(e, allowed)


def _check_expression(e, allowed: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and (name := ".".join(_seq(e.nameParts())).lower()).split(".")[-1] in BARRED:
        raise ValueError(f"function {name} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _check(e.plan(), allowed)
    if kind == "InSubquery":
        _check_expression(e.query(), allowed)
    for child in _seq(e.children()):
        _check_expression(child, allowed)


def guarded_sql(spark: SparkSession, tables: Mapping[str, DataFrame], text: str, most: int = 200, **params) -> DataFrame:
    """Run one reading statement over the tables; anything else is an error.

    The whole parsed plan is looked at: each node must be one that reads, each
    relation one of the tables or a common table of the statement, and no
    function may call out.  Parameters are bound (``:name``).
    """
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(text)
    except Exception as e:
        raise ValueError(f"not one statement: {str(e).splitlines()[0]}") from e
    _check(plan, {n.lower() for n in tables})
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params or None).limit(most)
