"""Operators for preparing training data: deduplication, archives, search, tokens, labels.

Nothing else in the library imports this package.
"""
