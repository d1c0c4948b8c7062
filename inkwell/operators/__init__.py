"""Operators of the search engine."""
