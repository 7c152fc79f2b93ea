"""Composite plans: the pipeline, the query registry and its SQL."""
