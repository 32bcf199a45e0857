"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own; ``queries`` registers the driver queries and their SQL.
"""
