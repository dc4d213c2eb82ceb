"""The registered queries: every operator on the given tables, with the SQL that must give the same rows."""

from . import cases, files, images, labels, tables  # noqa: F401  (they register their queries)
from .registry import oracles, queries

__all__ = ["oracles", "queries"]
