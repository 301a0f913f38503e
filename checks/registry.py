"""Every registered query."""

from checks import aggregates, cleaning, features, files, models  # noqa: F401
from checks.bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
