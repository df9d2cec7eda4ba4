"""Column expressions: text, hashes, versions, names and paths."""
