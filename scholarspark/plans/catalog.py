"""The registered queries and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from . import exchange, floats, graphs, layout, library, papers, retrieval, tex

_PLANS = (retrieval, library, papers, graphs, floats, tex, layout, exchange)

QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
