"""Operators put together: indexing, query modes, evaluation."""
