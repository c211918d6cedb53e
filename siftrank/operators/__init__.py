"""Operators, each a function from DataFrames to a DataFrame."""
