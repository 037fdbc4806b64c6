"""Incremental runs over what was processed before."""
