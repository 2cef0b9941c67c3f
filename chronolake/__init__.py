"""Activity analytics on Spark DataFrames."""
