"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

from .registered import extra, more  # noqa: F401  they register what they define
from .registered.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
