"""All queries of the library proper by name, with their SQL oracles."""

from __future__ import annotations

from .plans.base import ORACLES, QUERIES
from .plans import (  # noqa: F401  each registers its queries
    calibration, coverage, experiments, graph, logs, metrics, quality, reports, scans, scoring, selection, similarity,
)
