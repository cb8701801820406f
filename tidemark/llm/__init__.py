"""Operators of a training-data pipeline: dedup, quality, extraction, tokens, personal data, mixing, media."""
