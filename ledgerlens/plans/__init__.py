"""End-to-end analyses composed from operators: segments, lifetime value, baskets, recommenders."""
