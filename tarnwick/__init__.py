"""Tarnwick: a Spark-native engine for analysing collections of document records."""

__version__ = "0.1.0"
