"""Commit analytics on Spark: sources, text functions, weighting, views and queries."""
