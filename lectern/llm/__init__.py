"""Operators for training-data pipelines: language, duplicates, licences, mixing, shards.

Nothing else in the library imports this package.
"""
