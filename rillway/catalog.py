"""Every registered query with its SQL twin."""

from rillway.plans import aggregates, cdc, joins, parsing, patterns, search, subjects, windows  # noqa: F401  isort: skip
from rillway.plans import streams  # noqa: F401  isort: skip  (after the twins whose SQL it takes)
from rillway.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
