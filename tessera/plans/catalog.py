"""All registered queries with their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from tessera.plans import code, corpus, retrieval, streams

MODULES = (retrieval, corpus, code, streams)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
