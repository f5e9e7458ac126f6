"""Operators for large-scale training-data pipelines (see the modules for each method)."""
