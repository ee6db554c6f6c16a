"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    queries_comparative,
    queries_files,
    queries_geometry,
    queries_scoring,
    queries_selection,
    queries_sources,
    queries_state,
    queries_statistics,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
