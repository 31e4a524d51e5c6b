"""Registered queries and the DuckDB statements that check them."""
