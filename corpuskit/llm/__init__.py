"""Operators of a training-data pipeline and their registered queries.

Nothing outside this subpackage imports it.
"""
