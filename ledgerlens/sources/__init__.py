"""Readers, writers and the views that stand in for the analysts' input tables."""
