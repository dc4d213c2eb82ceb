"""Operators for large-scale training data: one module per operator, and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
