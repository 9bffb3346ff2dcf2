"""Incremental refresh as a Structured Streaming query."""
