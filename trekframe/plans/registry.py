"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import aggregates, composite, joins, scalars, sequences, sources_sinks, story, streams
from .base import ORACLES, QUERIES

#: Importing the modules registers their queries.
MODULES = (scalars, joins, sequences, aggregates, composite, story, sources_sinks, streams)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
