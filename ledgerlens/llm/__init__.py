"""Corpus preparation for language-model training: one module for each operator, queries in ``queries``."""
