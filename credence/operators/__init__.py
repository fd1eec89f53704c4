"""Operators on DataFrames: graph, vectors, search, retrieval, audit and metrics."""
