"""Knowledge-graph analytics on plain Spark DataFrames."""
