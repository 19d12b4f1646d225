"""All queries of the library itself."""

from terraweft.plans import capture, composites, documents, extras, geometry, live, matching, missions, rasters, records, streams  # noqa: F401
from terraweft.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
