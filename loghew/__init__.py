"""Log-template analytics on Spark DataFrames."""
