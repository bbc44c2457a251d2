"""Operators of a training-data pipeline: deduplication, filters, sharding and packing."""
