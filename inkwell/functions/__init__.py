"""Functions of the search engine."""
