"""Spark-first document investigation engine."""
