"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from . import detectors, entities, filters, graphs, scoring, sequences, sources, tables, texts  # noqa: F401
from .views import REGISTRY, SQL

QUERIES = REGISTRY
ORACLES = SQL
