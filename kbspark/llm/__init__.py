"""Operators that prepare training data; see ``queries.py`` for the named queries."""
