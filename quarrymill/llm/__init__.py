"""Operators for training-data pipelines.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
