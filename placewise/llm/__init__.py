"""Operators for large text corpora; each takes DataFrames and returns a DataFrame."""
