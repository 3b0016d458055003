"""Spark-first analytics for long spoken-business text."""
