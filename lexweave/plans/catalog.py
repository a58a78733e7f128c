"""All modules that register queries."""

from . import files, filters, joins, python_ops, spend, state, telemetry, text  # noqa: F401
