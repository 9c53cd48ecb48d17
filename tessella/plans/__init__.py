"""Whole queries: the benchmark report and the registered queries with their SQL."""
