"""Training-data operators: one module for each, all on Spark DataFrames."""
