"""Structured Streaming forms of the time buckets and the row alert."""
