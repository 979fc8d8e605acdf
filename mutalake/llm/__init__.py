"""Operators of a training-data pipeline: extraction, filtering, de-duplication, scoring and packing."""
