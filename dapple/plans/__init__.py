"""The queries on the driver tables, by family."""

from dapple.plans import decisions, files, knowledge, relational, texts  # noqa: F401
from dapple.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "fts_passage_search"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
