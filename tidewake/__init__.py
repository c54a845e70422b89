"""Clinical event analytics on Spark DataFrames."""
