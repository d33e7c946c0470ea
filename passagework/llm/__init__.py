"""Operators of a training-data pipeline: duplicates, tokens, filters, search and packing."""
