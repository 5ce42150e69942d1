"""Streaming use of the index."""
