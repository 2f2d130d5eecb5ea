"""Readers and writers. Each reader fixes its schema, so no inference pass is run."""
