"""Spark-first analytics over building-coordination data."""
