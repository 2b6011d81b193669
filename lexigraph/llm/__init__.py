"""Operators for training-data pipelines: search, dedup, extraction, scoring, mixing, packing."""

from .queries import queries
from .sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
