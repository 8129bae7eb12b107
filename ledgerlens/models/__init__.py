"""Clustering, boosting, model search and evaluation on Spark ML."""
