"""Imports every module that registers core queries."""

from __future__ import annotations

from rostrum.plans import analytics, assembly, ranking, retrieval, sequences, sources, streams, windows  # noqa: F401
from rostrum.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
