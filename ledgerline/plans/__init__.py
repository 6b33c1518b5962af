"""Registered queries: Spark plans paired with DuckDB oracle SQL."""
