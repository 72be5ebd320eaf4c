"""Annalist: a PySpark-native analytics engine for software-history data."""

__version__ = "0.1.0"
