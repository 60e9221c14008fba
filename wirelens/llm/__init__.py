"""Operators for training data: language, quality, duplicates, mixing, pieces, search, licences, fingerprints.

Every operator is a function from DataFrames to a DataFrame. ``queries`` applies each to its whole table.
"""
