"""Spark jobs over code corpora."""
