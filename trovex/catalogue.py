"""Every query of the engine's operators, by name, with its SQL."""

from __future__ import annotations

from trovex.plans import records, scalars, searching, usage
from trovex.plans.registry import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in (searching, usage, records, scalars):
    QUERIES |= _module.PLANS.queries
    SQL |= _module.PLANS.sql
