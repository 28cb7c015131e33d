"""Column expressions: cell keys and tag parsing."""
