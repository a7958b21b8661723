"""Operators for training-data pipelines: tokens, fingerprints, duplicates, filters.

Nothing outside this folder imports it. Every operator takes a DataFrame and the
names of the columns it needs, ignores all others (so foreign columns can't clash)
and returns only documented columns.
"""
