"""Column expressions: text, categories and dates, authors, vectors."""
