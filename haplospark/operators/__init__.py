"""Operators by family; importing this fills the registry."""

from . import aggregates, donors, filters, joins, phasing, reports, scaffolds, windows  # noqa: F401
