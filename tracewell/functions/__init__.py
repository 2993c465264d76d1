"""Column rules."""
