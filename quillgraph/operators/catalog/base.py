"""Registration of catalogue queries, and the vocabulary they share."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame

from ...plans.relation import Rel, lit, rel
from ...sources.driver_tables import ctes


@dataclass(frozen=True)
class Query:
    """``params`` holds the parameters with example values, as strings; ``defaults`` what stands for those that may be left out."""

    name: str
    category: str
    about: str
    params: dict[str, str]
    build: Callable[[SimpleNamespace], Rel]
    defaults: dict[str, str] = field(default_factory=dict)

    def plan(self, /, **given: str) -> Rel:
        """A parameter without a default must be given; parameters that the query has not are ignored."""
        values = {**self.defaults, **given}
        if missing := [k for k in self.params if k not in values]:
            raise ValueError(f"{self.name}: missing parameter {', '.join(missing)}; it takes {', '.join(self.params)}")
        return self.build(SimpleNamespace(**{k: lit(str(values[k])) for k in self.params}))

    def run(self, tables: Mapping[str, DataFrame], /, **given: str) -> DataFrame:
        return self.plan(**given).spark(tables)

    def example(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Run with the example values."""
        return self.run(tables, **self.params)

    def sql(self) -> str:
        """The example's plan for another engine."""
        plan = self.plan(**self.params)
        return ctes(plan.tables()) + plan.sql()

    def needs(self) -> set[str]:
        """Tables that must hold rows for the query to say anything."""
        return self.plan(**self.params).tables()


CATALOG: dict[str, Query] = {}


def define(category: str, name: str, about: str, build: Callable[[SimpleNamespace], Rel], /, *, optional: dict[str, str] | None = None, **params: str) -> None:
    """``params`` are examples; ``optional`` gives defaults."""
    assert name not in CATALOG, name
    CATALOG[name] = Query(name, category, about, params, build, optional or {})


def records(rows: Rel, *fields: str) -> Rel:
    """All rows as one JSON array of records."""
    return rel(rows, agg={"list": f"RECORDS({', '.join(f'{f}: {f}' for f in fields)})"}, out={"list": "list"})


def cols(alias: str, names: str) -> dict[str, str]:
    """``cols("e", "entity_id=id kind")``: output columns taken from an alias."""
    return {a.partition("=")[0]: f"{alias}.{a.partition('=')[2] or a}" for a in names.split()}


def dotted(alias: str, names: str) -> dict[str, str]:
    """Columns that keep their alias in the output name."""
    return {f"{alias}.{a}": f"{alias}.{a}" for a in names.split()}


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def all_of(*conditions: str) -> str:
    return " AND ".join(conditions)


def none_of(*conditions: str) -> str:
    return " AND ".join(f"NOT {c}" for c in conditions)


def has(column: str, *parts: str) -> str:
    """The column contains one of these texts."""
    found = [f"contains({column}, {p if p.startswith(chr(39)) else lit(p)})" for p in parts]
    return found[0] if len(found) == 1 else any_of(*found)


def lacks(column: str, *parts: str) -> str:
    return none_of(*(has(column, p) for p in parts))


def starts(column: str, *parts: str) -> str:
    found = [f"startswith({column}, {p if p.startswith(chr(39)) else lit(p)})" for p in parts]
    return found[0] if len(found) == 1 else any_of(*found)


def ends(column: str, *parts: str) -> str:
    found = [f"endswith({column}, {p if p.startswith(chr(39)) else lit(p)})" for p in parts]
    return found[0] if len(found) == 1 else any_of(*found)


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(lit, values))})"


def ladder(*steps: tuple[str, str], default: str) -> str:
    """The label of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {lit(v)}" for c, v in steps) + f" ELSE {lit(default)} END"


def ratio(a: str, b: str, scale: str = "1", empty: str = "0") -> str:
    """a / b as a double, 0 where b is 0."""
    return f"CASE WHEN {b} = 0 THEN CAST({empty} AS DOUBLE) ELSE CAST({a} AS DOUBLE) * {scale} / {b} END"


def count_if(condition: str) -> str:
    return f"coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0)"


# Shared predicates.
def outside_tests(alias: str) -> str:
    """Neither file nor symbol lies under a tests folder."""
    return all_of(lacks(f"{alias}.file", "tests/"), lacks(f"{alias}.symbol", "tests/"))


def no_test_symbol(alias: str) -> str:
    return lacks(f"{alias}.symbol", "tests", "test_")


def not_stub(alias: str) -> str:
    return f"NOT {ends(f'{alias}.file', '.pyi')}"


AXIS_ROLES = ("ontology-value", "ontology-axis", "ontology-entity")
META_ROLES = (*AXIS_ROLES, "ontology-migration")
STARTER_ROLES = (*META_ROLES, "index")


def starter(alias: str) -> str:
    return any_of(one_of(f"{alias}.role", META_ROLES), all_of(f"{alias}.role = 'index'", starts(f"{alias}.id", "ontology")))


def clustered(alias: str) -> str:
    return starts(f"{alias}.description", "Cluster anchored on")


def density(alias: str, first: int) -> str:
    """The description gives a density of 0.<first>0 to 0.<first>9."""
    return has(f"{alias}.description", *(f"density 0.{first}{k}" for k in range(10)))


def promotion(alias: str) -> str:
    return ladder((clustered(alias), "cluster-derived"), (has(f"{alias}.description", "`"), "promoted-with-pointer"), default="promoted-pure-semantic")


def counted(source, *joins, name: str, where: str | None = None, what: str = "count(*)") -> Rel:
    """One row with one count."""
    return rel(source, *joins, where=where, agg={name: what})


def side_by_side(first: Rel, *others: Rel, out: dict[str, str], **rest) -> Rel:
    """Several one-row relations as one row; aliases c0, c1, ..."""
    return rel(first, *(("cross", r, None, f"c{k}") for k, r in enumerate(others, 1)), alias="c0", out=out, **rest)


def tagged(doc: str, tag: str, alias: str, how: str = "semi") -> tuple:
    """Semi (or anti) join: the document carries the tag (a literal)."""
    return (how, "doc_tags", f"{alias}.doc_id = {doc}.id AND {alias}.value = {tag if tag.startswith(chr(39)) else lit(tag)}", alias)


TAG_LIST = rel("doc_tags t", by={"doc_id": "t.doc_id"}, agg={"tags": "LIST(t.value)"})
