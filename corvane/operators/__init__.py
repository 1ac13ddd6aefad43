"""Operators: DataFrames and driver options in, lazy DataFrames out."""
