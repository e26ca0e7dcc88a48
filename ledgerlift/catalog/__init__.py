"""All named queries and their SQL."""

from . import basics, documents, upkeep  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
