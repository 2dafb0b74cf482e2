"""Column builders: pure functions from Columns to Columns."""
