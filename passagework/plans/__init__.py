"""Composed pipelines: ingest, search, collection management."""
