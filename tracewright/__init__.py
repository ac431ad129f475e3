"""Spark-native evidence analytics over large collections of text packages."""

__version__ = "0.1.0"
