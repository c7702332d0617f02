"""Structured Streaming versions of the cleaning path."""
