"""Spark jobs for code corpora and training-data preparation."""
