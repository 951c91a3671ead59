"""Operators of a training-data pipeline: one module per operator.

Nothing outside this package imports it.  ``registry`` holds the queries and
their SQL; each operator module has a general interface of its own.
"""
