"""Relational, graph and statistical operators; every function takes and returns DataFrames."""
