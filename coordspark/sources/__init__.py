"""Readers, writers and the fixture views over the star-schema tables."""
