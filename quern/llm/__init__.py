"""Operators for large training-corpus preparation; nothing else in the library imports this package."""
