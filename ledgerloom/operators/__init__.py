"""Operators from DataFrames to DataFrames, to be chained with DataFrame.transform."""
