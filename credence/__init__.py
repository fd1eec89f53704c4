"""Credence: belief-graph analytics on Spark DataFrames."""
