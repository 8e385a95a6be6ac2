"""Spark-native document-to-speech-plan analytics."""

__version__ = "0.1.0"
