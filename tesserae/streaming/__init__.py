"""Streaming forms of the operators that only append."""
