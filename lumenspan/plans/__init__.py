"""Whole experiments, and the catalogue of queries with their SQL."""
