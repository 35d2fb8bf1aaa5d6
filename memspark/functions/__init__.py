"""Column expressions and policies."""
