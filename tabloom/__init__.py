"""Spark-native engine for preparing, profiling, encoding, reshaping and generating tabular data."""

__version__ = "0.1.0"
