"""Operators of a training-data pipeline: cleaning, dedup, scoring, mixing, encoding."""
