"""Decision-workload analytics on Spark DataFrames."""
