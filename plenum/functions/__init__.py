"""Column expressions: text, JSON, arrays, dates."""
