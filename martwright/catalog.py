"""Importing this module registers every query of the engine."""

from __future__ import annotations

from .queries import comparators, evaluation, relational, surface  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
