"""Operators bound to the driver's tables as named queries, each with its SQL oracle."""
