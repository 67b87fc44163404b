"""Operators of a training-data pipeline: text quality, extraction, near duplicates, tokens, packing."""
