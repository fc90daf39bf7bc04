"""Spark-native text search and corpus processing."""

__version__ = "0.1.0"
