"""Spark-native dataset curation and evaluation engine."""

__version__ = "0.1.0"
