"""Operators for training-data pipelines: filters, matching, extraction, token files and packing."""
