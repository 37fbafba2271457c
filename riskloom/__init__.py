"""Modelling tabular business data with Spark: DataFrames in, DataFrames out."""
