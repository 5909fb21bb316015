"""Column expressions: codes, types, measures, text."""
