"""Joins, merges, aggregates and validation over coordination tables."""
