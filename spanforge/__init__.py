"""Spark-first detection, reversible masking, restoration and evaluation of sensitive spans in text."""

__version__ = "0.1.0"
