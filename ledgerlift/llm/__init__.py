"""Operators that prepare training data from a table of documents."""
