"""Operators of a training-data pipeline: extraction, filters, duplicates, formatting, packing."""
