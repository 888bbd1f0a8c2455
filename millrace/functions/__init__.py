"""Column builders and table functions."""
