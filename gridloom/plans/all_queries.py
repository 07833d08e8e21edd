"""All registered queries."""

from gridloom.plans import action_queries, curation_queries, raster_queries, tile_queries  # noqa: F401
from gridloom.plans.catalog import ORACLES, QUERIES  # noqa: F401
