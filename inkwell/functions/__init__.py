"""Column expressions: text, hashes, vectors."""
