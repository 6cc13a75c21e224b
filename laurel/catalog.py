"""All queries of the library proper, by name, and the SQL they are checked against."""

from .plans import configs, distil, more, policies, ranking, roundtrips, scans, serving, stores, texts  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
