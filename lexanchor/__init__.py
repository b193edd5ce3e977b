"""Spark-native entity linking, vocabulary ETL and data-quality engine."""

__version__ = "0.1.0"
