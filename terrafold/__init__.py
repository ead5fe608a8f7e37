"""Spark operators for point, sensor and map tables, and for large text corpora."""
