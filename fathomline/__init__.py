"""Estate lineage analytics on Spark DataFrames."""
