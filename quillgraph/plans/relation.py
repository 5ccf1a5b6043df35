"""Declarative query plans with two renderings: a Spark DataFrame, and ANSI SQL.

A :class:`Rel` is one block: sources joined under aliases, a filter, a grouping
or a projection, an order and a limit.  Blocks nest as sources.  In Spark each
block becomes DataFrame operations over lazily built tables, so Catalyst sees
one declarative plan; as SQL it becomes one SELECT, which other engines can run
to check the result.

Expressions are SQL text in the dialect both sides share, with a few words that
differ: ``startswith``, ``endswith``, ``regexp_like``, ``a div b`` (integer division) and the
aggregates ``LIST(x)`` and ``SET(x)`` (all, or distinct, values of a column as
one comma-joined string in ascending order); ``BASENAME(x)`` is what follows
the last slash of a path.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Source = "str | Rel"


def lit(value: str | float) -> str:
    """A literal; parameters are put into plans with this alone."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def _spark_literals(e: str) -> str:
    """Doubled quotes in literals, as Spark escapes them; backslashes stay themselves."""

    def one(m: re.Match) -> str:
        return "'" + m[0][1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'"

    return re.sub(r"'(?:[^']|'')*'", one, e)


def _outside_literals(e: str, change) -> str:
    return "".join(change(x) if k % 2 == 0 else x for k, x in enumerate(re.split(r"('(?:[^']|'')*')", e)))


def _fields(text: str, form: str) -> str:
    """``a: x, b: y`` in another form."""
    return ", ".join(form.format(*(part.strip() for part in x.split(":", 1))) for x in text.split(","))


def spark_expr(e: str) -> str:
    def change(x: str) -> str:
        x = re.sub(r"\bBASENAME\(([^()]+)\)", r"element_at(split(\1, '/'), -1)", x)
        x = re.sub(r"\bSET\(([^()]+)\)", r"concat_ws(',', array_sort(collect_set(\1)))", x)
        x = re.sub(r"\bRECORDS\(([^()]+)\)", lambda m: f"to_json(array_sort(collect_list(struct({_fields(m[1], '{1} AS {0}')}))), map('ignoreNullFields', 'false'))", x)
        return re.sub(r"\bLIST\(([^()]+)\)", r"concat_ws(',', array_sort(collect_list(\1)))", x)

    return _spark_literals(_outside_literals(e, change))


def ansi_expr(e: str) -> str:
    def change(x: str) -> str:
        x = re.sub(r"\bBASENAME\(([^()]+)\)", r"string_split(\1, '/')[-1]", x)
        x = re.sub(r"\bSET\(([^()]+)\)", r"coalesce(string_agg(DISTINCT \1, ',' ORDER BY \1), '')", x)
        x = re.sub(r"\bRECORDS\(([^()]+)\)", lambda m: f"coalesce(CAST(to_json(list_sort(list(struct_pack({_fields(m[1], '{0} := {1}')})))) AS VARCHAR), '[]')", x)
        x = re.sub(r"\bLIST\(([^()]+)\)", r"coalesce(string_agg(\1, ',' ORDER BY \1), '')", x)
        x = x.replace("startswith(", "starts_with(").replace("endswith(", "ends_with(").replace("regexp_like(", "regexp_matches(")
        return re.sub(r"\bdiv\b", "//", x)

    return _outside_literals(e, change)


@dataclass(frozen=True)
class Join:
    how: str  # inner, left, semi, anti, cross
    source: Source
    alias: str
    on: str | None


@dataclass
class Rel:
    """See the module.  ``by`` and ``agg`` group; ``having``, ``out`` and ``order`` see the names given there (or in ``out``).

    ``fast`` is another block with the same rows, which Spark runs where the tables it needs are at hand; the SQL stays that of the block.
    """

    source: Source
    alias: str = "t"
    joins: list[Join] = field(default_factory=list)
    where: str | None = None
    by: dict[str, str] | None = None
    agg: dict[str, str] | None = None
    having: str | None = None
    out: dict[str, str] | None = None
    distinct: bool = False
    order: list[str] = field(default_factory=list)
    limit: int | None = None
    union: list[Rel] = field(default_factory=list)
    fast: Rel | None = None

    def tables(self) -> set[str]:
        found: set[str] = set()
        for s in (self.source, *(j.source for j in self.joins), *self.union):
            found |= {s} if isinstance(s, str) else s.tables()
        return found

    # ------------------------------------------------------------- Spark
    def spark(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        if self.fast is not None and all(n in tables for n in self.fast.tables()):
            return self.fast.spark(tables)

        def frame(s: Source) -> DataFrame:
            return tables[s] if isinstance(s, str) else s.spark(tables)

        def expr(e: str):
            return F.expr(spark_expr(e))

        df = frame(self.source).alias(self.alias)
        for j in self.joins:
            other = frame(j.source).alias(j.alias)
            if j.how == "cross":
                # only for sources of one row, or ranges that Spark cannot hash
                df = df.join(other, expr(j.on), "inner") if j.on else df.crossJoin(other)
            else:
                df = df.join(other, expr(j.on), {"semi": "left_semi", "anti": "left_anti"}.get(j.how, j.how))
        if self.where:
            df = df.where(expr(self.where))
        if self.agg is not None:
            keys = [expr(e).alias(n) for n, e in (self.by or {}).items()]
            df = df.groupBy(*keys).agg(*[expr(e).alias(n) for n, e in self.agg.items()])
        if self.having:
            df = df.where(expr(self.having))
        if self.out is not None:
            df = df.select(*[expr(e).alias(n) for n, e in self.out.items()])
        if self.distinct:
            df = df.distinct()
        for more in self.union:
            df = df.unionByName(more.spark(tables))
        if self.order:
            df = df.orderBy(*[F.col(f"`{n.lstrip('-')}`").desc() if n[0] == "-" else F.col(f"`{n}`").asc() for n in self.order])
        return df if self.limit is None else df.limit(self.limit)

    # --------------------------------------------------------------- SQL
    def sql(self) -> str:
        def src(s: Source, alias: str) -> str:
            return f'"{s}" AS {alias}' if isinstance(s, str) else f"({s.sql()}) AS {alias}"

        text, conditions = src(self.source, self.alias), []
        for j in self.joins:
            on = ansi_expr(j.on) if j.on else None
            if j.how in ("semi", "anti"):
                conditions.append(f"{'NOT ' * (j.how == 'anti')}EXISTS (SELECT 1 FROM {src(j.source, j.alias)} WHERE {on})")
            elif j.how == "cross" and on is None:
                text += f" CROSS JOIN {src(j.source, j.alias)}"
            else:
                text += f" {'LEFT' if j.how == 'left' else 'INNER'} JOIN {src(j.source, j.alias)} ON {on}"
        if self.where:
            conditions.append(f"({ansi_expr(self.where)})")
        where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
        named = lambda x: ", ".join(f'{ansi_expr(e)} AS "{n}"' for n, e in x.items())
        if self.agg is not None:
            keys = f" GROUP BY {', '.join(ansi_expr(e) for e in self.by.values())}" if self.by else ""
            q = f"SELECT {named({**(self.by or {}), **self.agg})} FROM {text}{where}{keys}"
            if self.having or self.out is not None:
                q = f"SELECT {named(self.out) if self.out is not None else '*'} FROM ({q}) AS grouped" + (f" WHERE {ansi_expr(self.having)}" if self.having else "")
        else:
            q = f"SELECT {named(self.out) if self.out is not None else '*'} FROM {text}{where}"
        if self.distinct:
            q = f"SELECT DISTINCT * FROM ({q}) AS d"
        if self.union:
            names = list(self.out or {**(self.by or {}), **(self.agg or {})})
            cols = ", ".join(f'"{n}"' for n in names)
            q = " UNION ALL ".join(f"SELECT {cols} FROM ({x}) AS u" for x in [q, *(m.sql() for m in self.union)])
        if self.order:
            keys = ", ".join(f'"{n.lstrip("-")}" DESC NULLS LAST' if n[0] == "-" else f'"{n}" ASC NULLS FIRST' for n in self.order)
            q = f"SELECT * FROM ({q}) AS s ORDER BY {keys}"
        return q if self.limit is None else f"{q} LIMIT {self.limit}"


def rel(source: Source, *joins: tuple, alias: str | None = None, **parts) -> Rel:
    """``rel("Function f", ("CALLS r", "r.dst = f.symbol"), ("semi", "File x", "..."), where=..., ...)``."""

    def named(s: Source, given: str | None) -> tuple[Source, str]:
        if isinstance(s, str):
            name, _, a = s.partition(" ")
            return name, given or a or "t"
        return s, given or "t"

    base, a = named(source, alias)
    made = []
    for j in joins:
        how, rest = (j[0], j[1:]) if isinstance(j[0], str) and j[0] in ("inner", "left", "semi", "anti", "cross") else ("inner", j)
        s, other = named(rest[0], rest[2] if len(rest) > 2 else None)
        made.append(Join(how, s, other, rest[1] if len(rest) > 1 else None))
    return Rel(base, a, made, **parts)
