"""Column expressions: scalar helpers, rating scores, special functions."""
