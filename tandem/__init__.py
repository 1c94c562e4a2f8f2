"""Tandem-repeat genotyping and data processing on PySpark."""

__version__ = "0.1.0"
