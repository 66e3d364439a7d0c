"""Spark-native analytics over layered conversational memory."""

__version__ = "0.1.0"
