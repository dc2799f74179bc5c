"""All queries of the library outside the training-data subpackage."""

from __future__ import annotations

from cadenza.plans import features, g2p, losses, sequence, sources, stats, training

_MODULES = (stats, sequence, g2p, features, losses, sources, training)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
