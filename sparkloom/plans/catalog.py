"""All registered queries of the engine and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from sparkloom.plans import ordered, relational, stored
from sparkloom.streaming import events, timers

MODULES = (relational, ordered, stored, events, timers)


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
