"""Wildfire-model evaluation on Spark: kernels as columns, metrics as aggregates, scoring and standard data as DataFrames."""

__version__ = "0.1.0"
