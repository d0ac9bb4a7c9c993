"""Document and event-store analytics on Spark DataFrames."""
