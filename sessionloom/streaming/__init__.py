"""Structured Streaming forms of the feature operators."""
