"""Operators for large training-data pipelines.

Nothing outside this package imports it. ``acurail.llm.queries`` binds the
operators to the driver tables.
"""
