"""Operators over leads and their companions: DataFrames in, DataFrames out."""
