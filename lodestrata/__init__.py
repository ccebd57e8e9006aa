"""Spark-native analytics for a personal memory store: facts, notes, links, statements, episodes."""

__version__ = "0.1.0"
