"""All registered queries."""

from . import catalog_suite, gazetteer_suite, points_suite, raster_suite, sources_suite, spatial_suite  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
