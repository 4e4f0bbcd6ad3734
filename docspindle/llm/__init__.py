"""Operators of a training-data pipeline: counting, search, mixing, dedup, scoring, PII."""
