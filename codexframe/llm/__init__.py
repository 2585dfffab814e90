"""Operators of a training-data pipeline: search, packing, scoring, scanning, deduplication, encoding."""
