"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
