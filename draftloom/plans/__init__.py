"""Registered queries and their DuckDB twins, by family."""
