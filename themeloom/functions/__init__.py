"""Column helpers: each takes columns and returns a column, with no state."""
