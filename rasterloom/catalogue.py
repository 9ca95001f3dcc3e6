"""Every registered query and its oracle SQL, gathered from the operator modules."""

from __future__ import annotations

from rasterloom.operators import coherence, corrections, inversion, linking, mosaic, provenance, stack, timeseries, unwrapping, validation
from rasterloom.plans import blocks, network

FLAGSHIP = "velocity_neff"
_MODULES = [network, blocks, timeseries, coherence, linking, stack, unwrapping, inversion, mosaic, corrections, provenance, validation]
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
