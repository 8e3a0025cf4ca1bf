"""Schemas, table readers and sinks."""
