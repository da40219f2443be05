"""Spark-first analytics for list-mode emission tomography data."""
