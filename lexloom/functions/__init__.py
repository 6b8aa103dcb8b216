"""Part of the lexloom engine."""
