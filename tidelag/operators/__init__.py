"""Lag, cross-basis, fitting, prediction and attribution operators."""
