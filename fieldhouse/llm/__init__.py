"""Operators of a training-data pipeline: filters, deduplication, sharding, encoding, formatting."""
