"""Whole pipelines and the registry of named queries."""
