"""Structured Streaming versions of the merges."""
