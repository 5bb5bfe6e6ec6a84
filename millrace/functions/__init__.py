"""Column functions and SQL functions."""
