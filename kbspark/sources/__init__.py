"""Typed table reads and writes, and the tables derived from the test data."""
