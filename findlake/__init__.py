"""Code-findings analytics on Spark DataFrames."""
