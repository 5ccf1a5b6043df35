"""An ontology kept as documents: values of axes, entities with their names, phrases and relations, and its version.

Documents come as (path, text).  What they declare stands in their front matter; a
role (or, in old files, a type) says what a document is.  Of documents that declare
one id, the one with the least path counts.  Files without an id of a value declare
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repository import bound, front_matter, listed, scalar

AXES = ("role", "kind", "lifecycle", "bounded-context")


def _declared(files: DataFrame, *roles: str) -> DataFrame:
    role = F.coalesce(scalar("role"), scalar("type"))
    return front_matter(files).withColumn("declared", role).where(F.col("declared").isin(*roles))


def _under(key: str) -> Column:
    """The lines indented under a key; a map on one line counts as well, one pair a line."""
    block = F.regexp_extract("front", rf"(?md)^{key}:[ \t\r]*\n((?:(?:[ \t]+|[ \t]*-)[^\n]*+(?:\n|\z))+)", 1)
    inline = F.regexp_extract("front", rf"(?md)^{key}:[ \t]*\{{([^\n]*)\}}[ \t\r]*$", 1)
    return F.concat(block, F.regexp_replace(inline, r"\s*,\s*", "\n"))


def _items(block: Column) -> Column:
    return F.filter(F.split(F.concat(F.lit("\n"), block), r"\n[ \t]*-[ \t]*"), lambda x: F.trim(x) != "")


def _part(item: Column, key: str) -> Column:
    value = F.regexp_extract(item, rf"(?:^|[\s{{,]){key}:[ \t]*(\"[^\"\n]*\"|'[^'\n]*'|[^\n,}}]*)", 1)
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(value, r"\r|\s#.*$", "")), "^[\"']|[\"']$", ""))


def _relations() -> Column:
    found = F.transform(_items(_under("relates_to")), lambda x: F.struct(_part(x, "target").alias("target"), _part(x, "type").alias("type")))
    return F.filter(found, lambda r: (r["target"] != "") & (r["type"] != ""))


def _attributes() -> Column:
    """``key=value`` texts of a map, or of a list of keys and values."""

    def pairs(block: Column) -> Column:
        rows = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[^\s:#][^:]*:\s*\S"))
        value = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1), r"\s#.*$", "")), "^[\"']|[\"']\\s*$", ""))
        mapped = F.transform(rows, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([^:]+):", 1)).alias("k"), value(x).alias("v")))
        given = F.transform(_items(block), lambda x: F.struct(_part(x, "key").alias("k"), _part(x, "value").alias("v")))
        return F.when(block.rlike(r"\A[ \t]*-"), given).otherwise(mapped)

    return F.transform(F.filter(bound(_under("attributes"), pairs), lambda p: p["k"] != ""), lambda p: F.concat_ws("=", p["k"], p["v"]))


def _first_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "path").alias("one"))
    return best.select(*keys, *[F.col("one")[c].alias(c) for c in rest])


def values(files: DataFrame) -> DataFrame:
    """(axis, id, display, description, requires_axes, allowed_lifecycle, filename_pattern, path) of the known axes; the lifecycle is null where all are allowed."""
    allowed = listed("allowed_lifecycle")
    rows = _declared(files, "ontology-value").select(
        scalar("axis_id").alias("axis"), scalar("value_id").alias("id"), F.coalesce(scalar("display"), scalar("value_id")).alias("display"), F.coalesce(scalar("description"), F.lit("")).alias("description"),
        listed("requires_axes").alias("requires_axes"), F.when(F.size(allowed) > 0, allowed).alias("allowed_lifecycle"), scalar("filename_pattern").alias("filename_pattern"), "path",
    )
    return _first_of_each(rows.where(F.col("id").isNotNull() & F.col("axis").isin(*AXES)), "axis", "id")


LISTS = ("synonyms", "bounded_contexts", "scanner_coverage", "source_modules", "code_terms", "code_veto")


def entities(files: DataFrame) -> DataFrame:
    """(id, display, description, synonyms, bounded_contexts, scanner_coverage, source_modules, code_terms, code_veto, relates_to, attributes, status, entity_class, path): what :func:`..operators.terms.entity_mentions` looks for.

    ``relates_to`` are (target, type), both given; ``attributes`` are ``key=value``.
    """
    rows = _declared(files, "ontology-entity").select(
        scalar("value_id").alias("id"), F.coalesce(scalar("display"), scalar("value_id")).alias("display"), F.coalesce(scalar("description"), F.lit("")).alias("description"),
        *[listed(k).alias(k) for k in LISTS], _relations().alias("relates_to"), _attributes().alias("attributes"), scalar("status").alias("status"), scalar("entity_class").alias("entity_class"), "path",
    )
    return _first_of_each(rows.where("id IS NOT NULL"), "id")


def relations(found: DataFrame) -> DataFrame:
    """(src, dst, type) of entities that :func:`entities` gave."""
    return found.select(F.col("id").alias("src"), F.explode("relates_to").alias("r")).select("src", F.col("r.target").alias("dst"), F.col("r.type").alias("type")).distinct()


def version(files: DataFrame) -> DataFrame:
    """(version): the highest that a document of the ontology names, 0 if none does."""
    rows = _declared(files, "ontology-axis", "ontology-value", "ontology-entity", "ontology-migration")
    return rows.withColumn("v", scalar("ontology_version")).agg(F.coalesce(F.max(F.expr("try_cast(v AS int)")), F.lit(0)).alias("version"))
