"""Import every catalog module so its queries register; re-export the registry."""

from filingscope.plans import catalog_cube, catalog_entities, catalog_exports, catalog_ingest, catalog_search, catalog_stats  # noqa: F401
from filingscope.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
