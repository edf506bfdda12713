"""Structured Streaming forms of the same dataflow."""
