"""Readers and writers, and the tables derived from the star schema."""
