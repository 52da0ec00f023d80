"""Spark-native analytics over long-term conversational memory."""

__version__ = "0.1.0"
