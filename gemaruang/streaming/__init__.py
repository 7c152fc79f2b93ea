"""Structured Streaming faces of the row-local verbs."""
