"""Earthquake-catalogue analytics on Spark: sources, column functions, operators, plans."""

__version__ = "0.1.1"
