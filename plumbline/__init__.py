"""Columnar, expression-style analytics on Spark DataFrames."""
