"""The engine's queries over the shared tables, by name, and SQL that gives the same rows."""

from __future__ import annotations

from lamella.plans import aggregates, boards, joining, readers, scalars, windows

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (windows, aggregates, joining, scalars, boards, readers):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
