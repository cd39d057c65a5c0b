"""Functions from DataFrames to a DataFrame, shared by batch and streaming."""
