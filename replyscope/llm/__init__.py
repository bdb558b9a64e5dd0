"""Operators of a training-data pipeline: deduplication, toxicity, licences, mixing, search and packing."""
