"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_identifier(name: Column) -> Column:
    """Words of an identifier: at case changes, digits, underscores, dashes and other signs; lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")


def slugify(text: Column) -> Column:
    """Lower case with runs of other signs as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def heading_slug(text: Column) -> Column:
    """Anchor of a heading: signs but dashes and underscores drop, spaces become dashes; letters and digits of all scripts stay."""
    return F.replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{IsAlphabetic}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def naive_plural(word: Column) -> Column:
    return F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def depluralise(word: Column) -> Column:
    return F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def first_line(text: Column, most: int = 120) -> Column:
    """The first line that has text, cut to a length."""
    return F.substring(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([^\n]*)", 1)), 1, most)


def simple_name(symbol: Column) -> Column:
    """The last name of a symbol, without call signs."""
    return F.regexp_extract(symbol, r"([A-Za-z0-9_]+)(?:\(\))?[.#]?$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def whole_match(text: Column, pattern: str) -> Column:
    """The pattern matches all of the text; null for null."""
    return text.rlike(f"^(?:{pattern})$")
