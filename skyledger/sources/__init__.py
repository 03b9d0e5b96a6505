"""Readers, writers and the observation view derived from the given tables."""
