"""Registered queries and their ANSI SQL counterparts."""

from __future__ import annotations

from tessera.plans import joins, partitions, q6

QUERIES = {**q6.QUERIES, **joins.QUERIES, **partitions.QUERIES}
ORACLES = {**q6.ORACLES, **joins.ORACLES, **partitions.ORACLES}
