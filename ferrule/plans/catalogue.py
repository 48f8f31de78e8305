"""All queries of the engine."""

from . import functions, indexes, ingest, memory, records, retrieval, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
