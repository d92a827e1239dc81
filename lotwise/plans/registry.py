"""Every named query of the engine and its SQL oracle."""

from __future__ import annotations

from lotwise.plans.oracle import ORACLE
from lotwise.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
