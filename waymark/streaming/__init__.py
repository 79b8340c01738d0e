"""Structured Streaming versions of the live counters."""
