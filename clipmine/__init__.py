"""Highlight analytics over many recordings at once, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
