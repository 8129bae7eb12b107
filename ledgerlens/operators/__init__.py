"""Reusable DataFrame operators: cleaning, order statistics, binning, outliers, profiling, encoding, neighbours."""
