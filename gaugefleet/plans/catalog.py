"""All queries over the driver tables, by name, and the SQL they must equal."""

from __future__ import annotations

from gaugefleet.plans import advice, checks, experiments, files, live, model, pairs, profiling, telemetry, texts, versions

_MODULES = (telemetry, profiling, pairs, experiments, advice, live, checks, texts, versions, model, files)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
