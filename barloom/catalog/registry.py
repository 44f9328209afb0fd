"""The registered queries and their SQL twins, one per inventory ID."""

from __future__ import annotations

from . import (aggregates, frame, indicators, learning, rows, sources, streams, trades)

_MODULES = (sources, rows, aggregates, indicators, frame, learning, trades, streams)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.SQL.items()}
