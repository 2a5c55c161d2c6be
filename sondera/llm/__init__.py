"""Operators that turn a raw crawl into training data. Nothing else in the library imports this."""
