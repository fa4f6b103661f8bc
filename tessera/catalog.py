"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from .plans import block_queries, detail_queries, flow_queries, plane_queries, run_queries, scene_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (plane_queries, block_queries, detail_queries, run_queries, flow_queries, scene_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
