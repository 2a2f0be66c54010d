"""Column functions: they take and return ``Column`` and stay inside Spark's expressions."""
