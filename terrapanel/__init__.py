"""Region-by-period panel analytics on Spark DataFrames."""
