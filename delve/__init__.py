"""Delve: change analytics and corpus processing on Spark DataFrames."""
