"""Operators over DataFrames: chunking, search, fusion, limits, sessions."""
