"""Column expressions: tail probabilities and reproducible hash draws."""
