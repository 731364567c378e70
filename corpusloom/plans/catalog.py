"""All queries of the engine by name."""

from corpusloom.plans import catalog_sources, catalog_tables, catalog_text  # noqa: F401  they register their queries
from corpusloom.plans.model import CATALOG, Query

__all__ = ["CATALOG", "Query"]
