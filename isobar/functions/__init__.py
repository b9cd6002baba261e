"""Column expressions and numerical helpers."""
