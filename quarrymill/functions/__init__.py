"""Column expressions; each is applied to whole tables by a job in ``operators``."""
