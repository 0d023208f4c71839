"""Queries over the engine's own operators, each with the SQL that gives the same rows."""

from .plans import geometry, rasters, repair, shapes, tables, terrain  # noqa: F401
from .plans.inputs import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
