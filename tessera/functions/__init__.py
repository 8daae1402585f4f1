"""Column expressions: text, vectors, path constraints."""
