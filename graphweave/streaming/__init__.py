"""Structured Streaming: documents that arrive over time."""
