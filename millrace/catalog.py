"""Registry of the named queries and their DuckDB equivalents."""

from __future__ import annotations

from millrace.plans import aggregates, gazette, joins, marts, ml, projections, quality, scalars, sinks, sources, streams, text, windows  # noqa: F401
from millrace.registry import ENTRIES

FLAGSHIP = "agg_1_revenue_hour_zone"
QUERIES = dict(ENTRIES)
ORACLES = {name: e.sql for name, e in ENTRIES.items() if e.sql}
