"""Sensitive-data analytics on Spark DataFrames."""
