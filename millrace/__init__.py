"""Recommendation analytics on Spark DataFrames."""
