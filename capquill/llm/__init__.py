"""Operators for large training-data pipelines: dedup, mixing, formatting, decontamination, sharding, quality."""
