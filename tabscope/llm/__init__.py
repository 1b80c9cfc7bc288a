"""Operators of a training-data pipeline: deduplication, token counts, mixing, classifiers, search, formatting."""
