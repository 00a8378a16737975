"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from veriloom.plans import flows, insights, landing, messages, registers, relational, scalars, structures, verdicts  # noqa: F401
from veriloom.plans.base import ORACLES, QUERIES

FLAGSHIP = "a15_verdict_ladder"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
