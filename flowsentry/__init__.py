"""Spark-native analytics over remote-desktop network traffic."""

__version__ = "0.1.0"
