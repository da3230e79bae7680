"""Column expressions: text, vectors, losses, names."""
