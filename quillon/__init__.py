"""Embedding-backed document collections as Spark DataFrames."""
