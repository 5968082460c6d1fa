"""Lumora: media-library analytics on PySpark (DataFrame, SQL, Structured Streaming)."""

__version__ = "0.1.0"
