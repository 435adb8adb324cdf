"""Table health and corpus preparation on Spark DataFrames."""
