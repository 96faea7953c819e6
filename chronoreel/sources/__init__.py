"""Readers, sources and tables derived from test data."""
