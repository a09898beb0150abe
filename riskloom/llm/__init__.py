"""Operators for training-data pipelines: tokens, duplicates, search, filters.

Nothing else in the library imports this subpackage.
"""
