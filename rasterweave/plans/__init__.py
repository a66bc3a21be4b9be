"""The registered queries and their SQL."""

from .raster import ORACLES, QUERIES, flagship  # noqa: F401
