"""Search and usage analytics on Spark DataFrames."""
