"""Missing-data analytics on Spark DataFrames."""
