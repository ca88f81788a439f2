"""Named queries of the core."""

from . import analysis, candidates, evaluation, files, packed, sampling
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis", "candidates", "evaluation", "files", "packed", "sampling"]
