"""Inputs (parquet tables, fixtures, spec documents) and outputs (sinks)."""
