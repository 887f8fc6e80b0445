"""Set-at-a-time clinical knowledge-graph analytics on Spark DataFrames."""
