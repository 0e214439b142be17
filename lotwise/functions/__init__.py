"""Column expressions: text, dates, numbers, hashes."""
