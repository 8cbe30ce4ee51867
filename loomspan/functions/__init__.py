"""Column expressions and plain functions."""
