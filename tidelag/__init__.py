"""Distributed lag analytics on Spark."""
