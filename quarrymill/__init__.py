"""Procurement price and demand analytics as Spark jobs."""
