"""Operators for building training data: text and vector tables in, DataFrames out."""
