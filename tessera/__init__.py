"""Evidence-aware graph queries, entity alignment and evaluation analytics as set-at-a-time Spark jobs."""
