"""Column expressions: scalar functions (P-series) and predicates (F-series)."""
