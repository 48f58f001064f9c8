"""Column expressions and SQL table functions."""
