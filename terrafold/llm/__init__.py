"""Operators for training-text pipelines; nothing outside this subpackage imports it."""
