"""Two-level stacked classification on Spark DataFrames."""
