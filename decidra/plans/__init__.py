"""Named queries over the given tables."""

from . import rows, scoring, shapes, trials, values
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "rows", "scoring", "shapes", "trials", "values"]
