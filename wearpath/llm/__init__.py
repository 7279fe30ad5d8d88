"""Operators of a training-data pipeline: scoring, formatting, filtering, deduplication, mixing and packing of texts."""
