"""Structured Streaming entry points of operators whose state can be kept small."""
