"""Siftkite: a Spark-native engine for vulnerability, finding and document analytics."""

__version__ = "0.1.0"
