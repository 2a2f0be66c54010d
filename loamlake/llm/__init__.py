"""Training-data operators: each module holds one, ``queries`` registers them over the given tables."""
