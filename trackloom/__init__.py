"""Track-association analytics on Spark DataFrames."""
