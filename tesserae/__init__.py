"""Describe large datasets with Spark: list, plan, checksum, annotate, validate."""
