"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark`` tables.

Nothing else in the library imports this subpackage.  Each operator takes DataFrames and returns a
DataFrame; ``queries`` registers one query per operator.
"""
