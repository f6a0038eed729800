"""All report queries in one catalogue."""

from __future__ import annotations

from folioscope.plans import extra, files, measures, people, ranks, sources, topics

_MODULES = [people, ranks, topics, measures, files, sources, extra]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
