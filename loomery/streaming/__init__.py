"""Streaming forms of the record operators."""
