"""Operators of a training-data pipeline over a ``documents`` table.

Nothing outside this package imports it; ``queries.py`` registers one query
per operator.
"""
