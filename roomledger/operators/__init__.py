"""The queries, as functions from tables and parameters to DataFrames."""
