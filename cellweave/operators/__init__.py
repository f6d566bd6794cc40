"""Operators: DataFrames in, DataFrame out; every grouping has image_id."""
