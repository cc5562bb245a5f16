"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; ``registry`` holds the
queries that the entry module adds when the subpackage is there.
"""
