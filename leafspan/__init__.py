"""Spark-native comparison and consistency analytics for JSON-like documents."""

__version__ = "0.1.0"
