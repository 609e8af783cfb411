"""Queries over the test tables, their input bindings and their DuckDB twins."""
