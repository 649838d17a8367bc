"""Operators that turn a crawled corpus into training data. Nothing else in the package imports this."""
