"""Spark-native analytics over a replicated knowledge graph."""

__version__ = "0.1.0"
