"""The registered queries of the river-network operators and their DuckDB SQL."""

from __future__ import annotations

from .plans import cells, chain, exchange, geometry, graph, grids, lookups, placed, relational, shapes, surfaces

# later modules replace queries of earlier ones that have the same name
_MODULES = [geometry, relational, graph, grids, lookups, shapes, cells, exchange, chain, placed, surfaces]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
#: Ordered vertices to edges, lengths, sinuosity and bounds of every line.
FLAGSHIP = "geo_sinuosity"
