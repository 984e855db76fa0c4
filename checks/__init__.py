"""Correctness checks against DuckDB (oracle SQL and a comparison runner)."""
