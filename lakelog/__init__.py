"""Lake search, column-name audit and run-log analytics on Spark DataFrames."""
