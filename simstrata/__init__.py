"""Similarity deduplication and delta storage of byte collections, built on Spark DataFrames."""

__version__ = "0.1.0"
