"""All queries of the package and their SQL."""

from __future__ import annotations

from . import field_queries, kernel_queries, pair_queries, raster_queries, segment_queries, sink_queries, spectral_queries  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
