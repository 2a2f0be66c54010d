"""DataFrame operators: they take and return ``DataFrame`` and never collect data."""
