"""Whole pipelines, parameter sweeps and the registered queries."""
