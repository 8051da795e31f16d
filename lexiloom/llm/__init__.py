"""Operators for training-data pipelines: each module holds one operator, ``queries`` holds the thin queries over them.

Nothing outside this subpackage imports it.
"""
