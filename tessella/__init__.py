"""Tessella: a PySpark-native engine for dense grids, ordinary tables and text corpora."""

__version__ = "0.1.0"
