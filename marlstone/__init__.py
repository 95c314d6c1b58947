"""Marlstone: retrieval analytics and corpus data processing on PySpark DataFrames."""

__version__ = "0.1.0"
