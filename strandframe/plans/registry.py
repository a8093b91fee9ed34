"""All queries outside the llm subpackage, by name."""

from __future__ import annotations

from strandframe.plans import calibration, evidence, integrity, models, videos

_MODULES = [integrity, evidence, videos, models, calibration]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
