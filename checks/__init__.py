"""Registered queries, each with the SQL that must give the same rows."""

from checks import estimates, generation, index, joins, repair, sampling, scans, scoring, staged, statistics
from checks.common import REGISTRY

__all__ = [
    "REGISTRY", "estimates", "generation", "index", "joins", "repair", "sampling", "scans", "scoring",
    "staged", "statistics",
]
