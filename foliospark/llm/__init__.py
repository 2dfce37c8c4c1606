"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it. Each module holds one operator with
its own general interface; ``catalog`` maps the operators to queries.
"""
