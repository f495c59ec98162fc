"""Spark-native semantic search over source files and documents."""

__version__ = "0.1.0"
