"""Jobs from tables to tables."""
