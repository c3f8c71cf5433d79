"""Registered queries: an operator call over the given tables, and the same result in SQL."""
