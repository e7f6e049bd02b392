"""Column expressions: numbers, text rules, intervals."""
