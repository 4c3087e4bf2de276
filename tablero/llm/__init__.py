"""Operators for training-data pipelines: one module per operator, one query module.

Nothing else in the library imports this subpackage.
"""
