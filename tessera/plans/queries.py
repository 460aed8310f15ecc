"""All registered queries of this library and their SQL."""

from tessera.plans import learner_queries, raster_queries, region_queries, sample_queries, slide_queries, table_queries
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "learner_queries", "raster_queries", "region_queries", "sample_queries", "slide_queries", "table_queries"]
