"""Acyclic-join analytics on Spark DataFrames."""
