"""Spark-native analytics for time-ordered trace and event data."""

__version__ = "0.1.0"
