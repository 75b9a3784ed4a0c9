"""Column expressions with the dialect's semantics."""
