"""Whole plans over the driver tables."""
