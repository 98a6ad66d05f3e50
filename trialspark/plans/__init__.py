"""Composed analyses: the health check and the portfolio audit."""
