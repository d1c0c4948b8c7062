"""Streaming of the search engine."""
