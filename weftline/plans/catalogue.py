"""The registered queries and, where SQL can express them, their checks."""

from __future__ import annotations

from weftline.plans import files, metrics, roundtrip, sequence

_PARTS = (metrics, sequence, files, roundtrip)
QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
