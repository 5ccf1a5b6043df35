"""The catalogue of named, parameterised analytic queries."""

from . import code, corpus, coupling, docs, entities, files, tags, tests_surface  # noqa: F401
from .base import CATALOG, Query

__all__ = ["CATALOG", "Query"]
