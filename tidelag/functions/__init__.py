"""Numeric helpers, piecewise polynomials and bases."""
