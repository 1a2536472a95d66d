"""Approximate string matching, n-gram language models and spell checking on Spark DataFrames."""

__version__ = "0.1.0"
