"""Queries over the given star-schema tables, and the same queries as plain SQL."""
