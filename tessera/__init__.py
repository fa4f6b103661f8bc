"""Block-signal analytics on Spark DataFrames."""
