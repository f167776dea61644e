"""All named queries and their SQL counterparts."""

from __future__ import annotations

from . import adapting, fused, judging, learning, lossless, moving, newsroom, price, scans

MODULES = (price, newsroom, fused, judging, adapting, moving, lossless, learning, scans)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
