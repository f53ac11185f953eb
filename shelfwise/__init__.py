"""Price-comparison analytics on Spark DataFrames."""
